"""Vocabularies of market texts: themes, places, sizes, intents, catalysts, news."""

from __future__ import annotations

#: What results depend on. Phrases of each theme, with its sectors and industries.
THEMES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "defense": (["defense", "defence", "aerospace", "military", "weapons", "munitions", "ammunition", "arms", "nato", "missile", "fighter jet", "warship", "army", "navy"], ["Industrials"], ["Aerospace & Defense"]),
    "semiconductors": (["semiconductor", "semiconductors", "chip", "chips", "chipmaker", "wafer", "foundry", "lithography", "semiconductor equipment", "chip equipment", "fab"], ["Technology"], ["Semiconductors", "Semiconductor Equipment"]),
    "nuclear_energy": (["nuclear", "uranium", "reactor", "smr", "small modular reactor", "enrichment", "fission", "atomic energy"], ["Energy", "Utilities"], ["Nuclear", "Uranium"]),
    "grid_electrification": (["grid", "electrification", "power grid", "transmission", "substation", "transformer", "electrical equipment", "electrical grid", "utilities", "utility"], ["Utilities", "Industrials"], ["Electrical Equipment", "Utilities"]),
    "robotics_automation": (["robotics", "robot", "robots", "automation", "industrial automation", "factory automation", "motion control", "cobot", "cobots"], ["Industrials", "Technology"], ["Robotics & Automation"]),
    "biotech_pharma": (["biotech", "biotechnology", "pharma", "pharmaceutical", "pharmaceuticals", "biopharma", "therapeutics", "gene therapy", "drug maker"], ["Healthcare"], ["Biotechnology", "Pharmaceuticals"]),
    "banks_fintech": (["bank", "banks", "banking", "fintech", "payments", "financial technology", "neobank", "lender"], ["Financials"], ["Banks", "Financial Technology"]),
    "mining_materials": (["mining", "miner", "miners", "copper", "lithium", "rare earth", "cobalt", "nickel", "uranium mining", "metals"], ["Materials"], ["Mining", "Metals & Mining"]),
    "ai_infrastructure": (["ai infrastructure", "artificial intelligence infrastructure", "data center", "data centre", "data centers", "hyperscaler", "cloud infrastructure", "gpu", "ai accelerator", "ai chips"], ["Technology"], ["Data Centers", "AI Infrastructure"]),
    "luxury_goods": (
        ["luxury", "luxury goods", "luxury brands", "watch", "watches", "watchmaker", "watchmakers", "watchmaking", "timepiece", "timepieces", "jewelry", "jewellery", "watches & jewelry", "watches and jewelry", "watches & jewellery", "watches and jewellery", "personal goods", "leather goods", "handbag", "handbags", "premium brands", "high-end consumer", "fashion luxury"],
        ["Consumer Discretionary"], ["Luxury Goods", "Watches & Jewelry", "Personal Goods", "Apparel & Accessories"],
    ),
}
REGIONS = {
    "Europe": ["europe", "european", "eurozone", "eu", "nordic"], "North America": ["us", "u.s.", "usa", "united states", "american", "america", "north america", "canada", "canadian"], "Japan": ["japan", "japanese"], "China": ["china", "chinese"],
    "Asia": ["asia", "asian", "korea", "korean", "taiwan", "taiwanese", "india", "indian"],
}
COUNTRIES = {
    "Germany": ("Europe", ["germany", "german"]), "France": ("Europe", ["france", "french"]), "United Kingdom": ("Europe", ["united kingdom", "uk", "britain", "british"]), "Italy": ("Europe", ["italy", "italian"]), "Spain": ("Europe", ["spain"]),
    "Sweden": ("Europe", ["sweden", "swedish"]), "Netherlands": ("Europe", ["netherlands", "dutch"]), "Switzerland": ("Europe", ["switzerland", "swiss"]), "Denmark": ("Europe", ["denmark", "danish"]), "Hong Kong": ("Asia", ["hong kong"]),
    "Japan": ("Japan", ["japan", "japanese"]), "China": ("China", ["china", "chinese"]), "United States": ("North America", ["united states", "us", "usa", "u.s.", "u.s.a."]), "Canada": ("North America", ["canada", "canadian"]),
}
SIZES = {"micro_cap": ["micro-cap", "micro cap", "microcap"], "small_cap": ["small-cap", "small cap", "smallcap", "smid"], "mid_cap": ["mid-cap", "mid cap", "midcap"], "large_cap": ["large-cap", "large cap", "largecap", "mega-cap", "megacap", "mega cap"]}
INTENTS = {
    "source": ["filing", "filings", "sec", "press release", "earnings", "regulatory"],
    "catalyst": ["catalyst", "catalysts", "positive catalyst", "tailwind", "spending", "order", "orders", "contract", "backlog", "growth", "demand", "expansion"],
    "risk": ["risk", "risks", "volatile", "cyclical", "regulatory risk", "supply chain"],
    "vague": ["best stock", "best stocks", "good stock", "good stocks", "stocks to buy", "top stocks", "top companies", "make money", "hot stocks", "winning stocks", "anything", "any company", "all stocks"],
}
EXCLUSIONS = ["excluding", "except", "without", "not including", "avoid"]

#: Catalysts. Category and direction of filing items, categories of forms, and of words in order of precedence.
ITEMS = {
    "1.01": ("contract", "neutral"), "1.02": ("risk_event", "negative"), "2.01": ("mna", "mixed"), "2.02": ("earnings", "neutral"), "2.03": ("financing", "neutral"), "2.05": ("risk_event", "negative"), "2.06": ("risk_event", "negative"),
    "3.01": ("risk_event", "negative"), "3.02": ("financing", "mixed"), "4.01": ("risk_event", "negative"), "5.02": ("management", "unknown"), "7.01": ("filing_event", "neutral"), "8.01": ("filing_event", "neutral"), "9.01": ("filing_event", "neutral"),
}
FORMS = dict.fromkeys(["10-K", "10-Q", "10-K/A", "10-Q/A", "20-F", "40-F", "6-K"], "filing_event") | dict.fromkeys(["DEF 14A", "DEFA14A"], "management") | dict.fromkeys(["S-3", "S-8", "S-1"], "financing")
NEGATIVE = [
    "investigation", "lawsuit", "sued", "subpoena", "recall", "impairment", "restatement", "restate", "guidance cut", "cuts guidance", "lowers guidance", "misses estimate", "missed estimate", "delist", "bankrupt", "downgrade", "regulatory warning",
    "data breach", "fraud", "probe", "penalt", "sanction", "resign", "steps down", "short seller", "going concern", "default",
]
POSITIVE = [
    "contract award", "awarded contract", "wins contract", "new partnership", "launches", "unveils", "record revenue", "raises guidance", "raised guidance", "beats estimate", "beat estimate", "repurchase authorization", "dividend increase",
    "raises dividend", "special dividend", "approval granted", "receives approval", "expansion", "record backlog",
]
CATEGORIES = {
    "mna": ["acquisition", "acquires", "acquire", "merger", "merges", "takeover", "divest", "disposal"], "litigation": ["lawsuit", "sued", "litigation", "court", "settlement", "subpoena", "class action"], "capital_return": ["dividend", "repurchase", "capital return"],
    "partnership": ["partnership", "partner", "collaboration", "joint venture", "alliance"], "financing": ["offering", "notes due", "credit facility", "private placement", "debt financing", "raises capital", "equity offering", "convertible"],
    "management": ["ceo", "cfo", "chief executive", "chief financial", "appoint", "resign", "steps down", "board of directors", "director"], "regulatory": ["regulator", "regulatory", "fda", "compliance", "antitrust", "clearance"],
    "guidance": ["guidance", "outlook", "forecast"], "earnings": ["earnings", "quarterly results", "revenue", "eps", "profit", "net income"], "product": ["launch", "unveil", "product", "release", "new model"], "contract": ["contract", "award", "deal", "order"],
    "customer": ["customer", "client win"], "operations": ["restructuring", "layoff", "facility", "production", "capacity", "operations"], "macro_sector": ["sector", "industry-wide", "macro", "tariff"],
}
MATERIAL = ["mna", "litigation", "regulatory", "capital_return", "financing", "management", "contract", "guidance", "risk_event"]
DECISIVE = ["mna", "litigation", "regulatory", "capital_return", "financing", "guidance", "earnings", "contract", "customer", "risk_event"]
PRAISE = ["glassdoor", "best ceos", "best places to work", "top workplaces", "great place to work", "most admired", "named to", "tops the list", "tops glassdoor", "list of best", "wins award", "award winner", "honored", "recognized as", "recognised as"]
MARKETING = ["geforce now", "new games", "game pass", "stream pc games", "gfn thursday", "blog post", "tips and tricks", "how to get started", "sweepstakes", "giveaway", "holiday gift", "developer blog"]
SCHEDULES = ["sets conference call", "to report ", "conference call for", "webcast", "to present at", "will participate in", "schedules ", "announces date", "invitation to"]
EVIDENCE = {1: "primary_confirmed", 2: "regulator_confirmed", 3: "single_source_reported", 4: "single_source_reported", 5: "aggregator_only"}
SURENESS = {"multi_source_confirmed": 0.8, "regulator_confirmed": 0.7, "primary_confirmed": 0.7, "single_source_reported": 0.5, "aggregator_only": 0.35, "model_inferred": 0.2}

#: News about companies.
SUFFIXES = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "holdings", "holding", "group", "sa", "ag", "nv", "the", "and", "class", "companies", "worldwide", "international"]
AMBIGUOUS = ["apple", "amazon", "meta", "block", "square", "target", "gap", "shell", "visa", "mastercard", "oracle", "arm", "nvidia", "broadcom", "ford", "general", "united", "american", "national", "capital", "match", "carnival"]
FINANCE = [
    "earnings", "revenue", "guidance", "quarterly", "results", "dividend", "shares", "shareholder", "sec", "filing", "10-k", "10-q", "8-k", "ceo", "cfo", "forecast", "nasdaq", "nyse", "investor", "profit", "sales", "market cap", "acquisition",
    "merger", "stock", "analyst", "outlook", "product launch", "contract", "partnership", "regulator",
]
KITCHEN = ["recipe", "orchard", "fruit", "pie", "cider", "harvest", "grocery", "snack", "juice", "farmer", "crop", "dessert", "smoothie", "cooking", "baking", "salad", "vinegar"]
CATALYSTS = ["launch", "unveil", "acquire", "acquisition", "merger", "contract", "lawsuit", "investigation", "guidance", "earnings", "partnership", "dividend", "recall", "approval", "regulatory", "resign", "appoint"]
