"""Theses, catalysts and news: what market texts are about, by tables of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import market as V
from tessera.functions import text as T
from tessera.operators import keywords as K


def _table(entries: dict, key: Column, otherwise=None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]), key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def _ranks(uses: list[tuple[str, str, list[str]]]) -> list[tuple[str, int, str, str]]:
    """(phrase, rank, use, value) for each phrase of each (use, value, phrases), ranked in order."""
    return [(p, i, use, value) for i, (use, value, ps) in enumerate(uses) for p in ps]


def _used(found: DataFrame, rows: list[tuple[str, int, str, str]]) -> DataFrame:
    """found with (rank, use, value) of each phrase; a phrase may serve several uses."""
    table = found.sparkSession.createDataFrame(rows, "phrase string, rank int, use string, value string")
    return found.join(F.broadcast(table), "phrase")  # as many rows as this module's vocabulary has


def parsed_theses(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Themes, keywords, sectors, industries, regions, countries, sizes, intents (each in the order of its table, comma-joined),
    theme and country (the first), region (the country's, else the first), excluded (the first word after each connective) and
    vague, of every text that says anything; phrases stand between white space. keys must tell rows apart."""
    folded = F.trim(F.regexp_replace(F.col(text_col), r"\s+", " "))
    uses = [("theme", t, ps) for t, (ps, _, _) in V.THEMES.items()] + [("country", c, ps) for c, (_, ps) in V.COUNTRIES.items()] + [("region", r, ps) for r, ps in V.REGIONS.items()]
    uses += [("size", s, ps) for s, ps in V.SIZES.items()] + [("intent", i, ps) for i, ps in V.INTENTS.items()]
    rows = _ranks(uses)
    found = _used(K.matches(df.select(*keys, folded.alias("__t")), keys, "__t", [(p, "spaced") for p, *_ in rows]), rows)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.v), ",")
    of = lambda use: F.when(F.col("use") == use, F.struct(F.col("rank"), F.col("value").alias("v")))
    said = found.groupBy(*keys).agg(
        *[listed(of(u)).alias(f"{u}s") for u in ("theme", "country", "size", "intent")], F.array_sort(F.collect_set(of("region"))).alias("__regions"), F.array_sort(F.collect_set(of("country"))).alias("__countries"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("use") == "theme", F.col("phrase")))), ",").alias("keywords"), F.min(of("theme")).alias("__theme"), F.min(of("country")).alias("__country"),
        F.bool_or((F.col("use") == "intent") & (F.col("value") == "vague")).alias("vague"),
    )
    region_of = {c: r for c, (r, _) in V.COUNTRIES.items()}
    regions = F.array_distinct(F.concat(F.transform("__regions", lambda r: r.v), F.transform("__countries", lambda c: _table(region_of, c.v))))
    implied = lambda i: F.array_join(F.array_distinct(F.flatten(F.transform(F.split("themes", ","), lambda t: F.coalesce(F.element_at(F.create_map(*[x for name, spec in V.THEMES.items() for x in (F.lit(name), F.array(*map(F.lit, spec[i])))]), t), F.array().cast("array<string>"))))), ",")
    said = said.select(
        *keys, "themes", "keywords", implied(1).alias("sectors"), implied(2).alias("industries"), F.array_join(regions, ",").alias("regions"), F.col("countrys").alias("countries"), "sizes", "intents", F.col("__theme.v").alias("theme"), F.col("__country.v").alias("country"),
        F.coalesce(_table(region_of, F.col("__country.v")), F.get("__regions", 0).v).alias("region"), "vague",
    )
    after = F.array_distinct(F.regexp_extract_all(F.lower(folded), F.lit(r"(?:^|[^a-z0-9])(?:" + "|".join(V.EXCLUSIONS) + r")[^a-z0-9]+([a-z0-9]+)"), F.lit(1)))
    excluded = df.select(*keys, F.array_join(F.array_sort(after), ",").alias("excluded")).filter("excluded <> ''")
    return said.join(excluded, keys, "full").withColumn("vague", F.coalesce("vague", F.lit(False)))


def classified_catalysts(events: DataFrame, key: str) -> DataFrame:
    """R19 on columns headline, summary, tier (1 to 6), form, items (array), is_filing, multi_source, has_source: category, direction,
    strength, evidence, materiality, confidence and basis of every event.

    A filing's items come first, the first adverse one before the first known one, then its form, then words by precedence; the words'
    direction replaces a neutral or unknown one. What lends an event its evidence, how its strength follows, and which posts are of low
    signal whatever their source, are tables.
    """
    x = events.select(key, "tier", "form", "items", "is_filing", "multi_source", (F.coalesce(F.length("summary") > 20, F.lit(False)) | F.coalesce("has_source", F.lit(False))).alias("detail"), F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit(""))).alias("__text"))
    uses = [("category", c, ps) for c, ps in V.CATEGORIES.items()] + [("negative", "", V.NEGATIVE), ("positive", "", V.POSITIVE), ("low", "praise", V.PRAISE), ("low", "marketing", V.MARKETING), ("schedule", "", V.SCHEDULES)]
    rows = _ranks(uses)
    found = _used(K.matches(x.filter(F.col(key).isNotNull()), [key], "__text", [(p, "anywhere") for p, *_ in rows]), rows)
    told = found.groupBy(key).agg(F.min(F.when(F.col("use") == "category", F.struct("rank", "value"))).alias("__word"), *[F.bool_or(F.col("use") == u).alias(f"__{u}") for u in ("negative", "positive", "low", "schedule")])
    x = x.join(told, key, "left").na.fill(False, [f"__{u}" for u in ("negative", "positive", "low", "schedule")])
    trimmed = F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda i: F.trim(i))
    known = F.filter(F.transform(trimmed, lambda i: F.struct(_table({k: c for k, (c, _) in V.ITEMS.items()}, i).alias("c"), _table({k: d for k, (_, d) in V.ITEMS.items()}, i).alias("d"))), lambda p: p.c.isNotNull())
    item = F.coalesce(F.get(F.filter(known, lambda p: p.d == "negative"), 0), F.get(known, 0))
    form = F.coalesce(_table(V.FORMS, F.upper("form")), _table(V.FORMS, F.col("form")))
    word = F.coalesce("__word.value", F.lit("other"))
    both = F.col("__negative") & F.col("__positive")
    toward = F.when(both, "mixed").when(F.col("__negative"), "negative").when(F.col("__positive"), "positive").when(word == "other", "unknown").otherwise("neutral")
    worded = F.when(F.col("__negative") & ~F.col("__positive") & word.isin("other", "operations"), "risk_event").otherwise(word)
    x = x.select("*", item.c.alias("__ic"), item.d.alias("__id"), form.alias("__form"), worded.alias("__wc"), toward.alias("__wd"))
    given = F.coalesce("__id", F.when(F.col("__form").isNotNull(), "neutral"))
    x = x.withColumns({
        "category": F.coalesce("__ic", "__form", "__wc"), "basis": F.when(F.col("__ic").isNotNull(), "items").when(F.col("__form").isNotNull(), "form").otherwise("words"),
        "direction": F.when(given.isNull() | (given.isin("neutral", "unknown") & F.col("__wd").isin("negative", "positive", "mixed")), F.col("__wd")).otherwise(given),
        "evidence": F.when(F.col("multi_source"), "multi_source_confirmed").otherwise(_table(V.EVIDENCE, F.col("tier"), "model_inferred")),
    })
    primary = F.col("evidence").isin("regulator_confirmed", "primary_confirmed", "multi_source_confirmed")
    strength = (
        F.when(primary & F.col("category").isin(V.MATERIAL) & (F.col("direction") != "unknown"), "high").when(primary | (F.col("evidence") == "single_source_reported"), "medium")
        .when((F.col("evidence") == "aggregator_only") & F.col("detail"), "low").otherwise("unknown")
    )
    materiality = F.when(F.col("__low"), "low_signal").when(F.col("__schedule"), "contextual").when(F.coalesce("is_filing", F.lit(False)) | F.col("category").isin(V.DECISIVE), "decision_relevant").otherwise("contextual")
    x = x.withColumns({"materiality": materiality, "strength": F.when((strength == "high") & (materiality == "low_signal"), "low").otherwise(strength)})
    sure = _table(V.SURENESS, F.col("evidence"), 0.2) + F.when(F.col("strength") == "high", 0.1).when(F.col("strength") == "unknown", -0.1).otherwise(0.0) - F.when(F.col("direction") == "unknown", 0.1).otherwise(0.0)
    return x.select(key, "category", "direction", "strength", "evidence", "materiality", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 2).alias("confidence"), "basis")


def brand_tokens(name: Column) -> Column:
    """Tokens of a legal name in order, without suffixes and single characters."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(V.SUFFIXES))


def _level(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("irrelevant")


def matched_news(news: DataFrame, companies: DataFrame, item: str, company: str, as_of: str, days: int = 90, social: list[str] | None = None, poor: list[str] | None = None) -> DataFrame:
    """News (item, text, url, tier, published) that names companies (company, name, ticker): item, company, score, level, specific and how
    it was named. Only pairs with a common token meet: an inverted index of brand tokens and tickers joins the items' distinct words, and a
    token that very many companies share is a hot key on both sides, which adaptive execution splits.

    Nothing for domains of `poor` markers (score .05) and for brand words of the kitchen without ticker or finance (0). Else .40 for a ticker,
    .40 for a name (.25 for one ambiguous word), .15 or .10 by tier, .10 for or against recency, .05 for a catalyst word, less .10 on
    social media. Specific is a ticker, or a name that isn't one ambiguous word without finance around it. Industry context, which
    isn't of a company, is industry_news()."""
    host = T.domain(F.coalesce("url", F.lit("")))
    uses = _ranks([("finance", "", V.FINANCE), ("kitchen", "", V.KITCHEN), ("catalyst", "", V.CATALYSTS)])
    hits = _used(K.matches(news.filter(F.col(item).isNotNull()), [item], "text", [(p, "anywhere") for p, *_ in uses]), uses)
    context = hits.groupBy(item).agg(*[F.bool_or(F.col("use") == u).alias(u) for u in ("finance", "kitchen", "catalyst")])
    age = F.datediff(F.lit(as_of).cast("date"), F.substring("published", 1, 10).try_cast("date"))
    facts = news.select(item, host.alias("host"), "tier", age.between(0, days).alias("recent"))
    words = news.select(item, F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2))).alias("token"))
    tokens = brand_tokens(F.col("name"))
    symbol = F.when(F.length("ticker") >= 2, F.lower("ticker"))
    index = companies.select(company, F.size(tokens).alias("n"), F.get(tokens, 0).alias("first"), F.explode(F.array_distinct(F.concat(F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(False).alias("is_ticker"))), F.when(symbol.isNotNull(), F.array(F.struct(symbol.alias("token"), F.lit(True).alias("is_ticker")))).otherwise(F.array().cast("array<struct<token:string,is_ticker:boolean>>"))))).alias("t"))
    index = index.select(company, ((F.col("n") == 1) & F.col("first").isin(V.AMBIGUOUS)).alias("ambiguous"), "t.*")
    pairs = words.join(index, "token").groupBy(item, company).agg(F.bool_or("is_ticker").alias("ticker"), F.count_if(~F.col("is_ticker")).alias("names"), F.first("ambiguous").alias("ambiguous"))
    x = pairs.join(facts, item).join(context, item, "left").na.fill(False, ["finance", "kitchen", "catalyst"])
    named = F.col("names") > 0
    low_quality = F.lit(False)
    for marker in poor or []:
        low_quality = low_quality | F.contains("host", F.lit(marker))
    is_social = T.by_domain(F.col("host"), dict.fromkeys(social, True)) if social else F.lit(None).cast("boolean")
    score = F.when(F.col("ticker"), 0.40).otherwise(0.0) + F.when(named, F.when(F.col("ambiguous"), 0.25).otherwise(0.40)).otherwise(0.0) + F.when(F.col("tier") <= 2, 0.15).when(F.col("tier") <= 4, 0.10).otherwise(0.0)
    score = score + F.when(F.col("recent"), 0.10).when(~F.col("recent"), -0.10).otherwise(0.0) + F.when(F.col("catalyst"), 0.05).otherwise(0.0) - F.when(F.coalesce(is_social, F.lit(False)), 0.10).otherwise(0.0)
    kitchen = named & F.col("kitchen") & ~F.col("ticker") & ~F.col("finance")
    final = F.when(low_quality, 0.05).when(kitchen, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))), 2))
    specific = ~low_quality & ~kitchen & (F.col("ticker") | (named & (~F.col("ambiguous") | F.col("finance") | (F.col("names") >= 2))))
    return x.select(item, company, final.alias("score"), specific.alias("specific"), F.when(F.col("ticker") & named, "ticker,name").when(F.col("ticker"), "ticker").otherwise("name").alias("named_by"), (low_quality | kitchen).alias("filtered")).withColumn("level", _level(F.col("score")))


def industry_news(news: DataFrame, groups: DataFrame, item: str, group: str) -> DataFrame:
    """Items that speak of a group's sector or industry (group, phrase): a row for each item and group, not for each company in it. A
    phrase is met by any of its words of four letters or more."""
    words = news.select(item, F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 4))).alias("token"))
    index = groups.select(group, F.explode(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("phrase"), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) >= 4))).alias("token")).distinct()
    return words.join(index, "token").groupBy(item, group).agg(F.count(F.lit(1)).alias("words"))


def with_industry_floor(scored: DataFrame, industry: DataFrame, members: DataFrame, item: str, company: str, group: str, floor: float = 0.45) -> DataFrame:
    """Of matched pairs that are neither specific nor filtered, those whose company's group the item speaks of are industry context, with at
    least the floor. Pairs are looked up one by one: no row is made for a company that an item doesn't name."""
    spoken = industry.select(item, group).withColumn("__spoken", F.lit(True))
    x = scored.join(members.select(company, group), company, "left").join(spoken, [item, group], "left")
    context = ~F.col("specific") & ~F.col("filtered") & F.coalesce("__spoken", F.lit(False))
    return x.withColumns({"is_industry_context": context, "score": F.when(context, F.greatest("score", F.lit(floor))).otherwise(F.col("score"))}).withColumn("level", _level(F.col("score"))).drop("__spoken")


def search_plans(df: DataFrame, keys: list[str], exchange: list[str], filings: list[str], banned: list[str], most: int = 10) -> DataFrame:
    """K31 on columns ticker, name, sector and industry: keys, kind, n and query of each company's plan of at most `most` searches.

    Queries that hold a banned phrase are left out, equal ones (case aside) stay once, in order. A third of the budget goes to the company,
    then at most three to primary sources, three to the industry and two to the exchange, the rest to the regulator. exchange and
    filings are templates with {ticker}, {company}, {sector} and {industry}. Without a name the ticker stands for it."""
    ticker = F.upper(F.coalesce("ticker", F.lit("")))
    name = F.when(F.coalesce("name", F.lit("")) == "", ticker).otherwise(F.col("name"))
    sector, industry = (F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("sector", "industry"))

    def filled(template: str) -> Column:
        text = F.lit(template)
        for place, value in (("ticker", ticker), ("company", name), ("sector", F.coalesce(sector, F.lit(""))), ("industry", F.coalesce(industry, F.lit("")))):
            text = F.replace(text, F.lit("{" + place + "}"), value)
        return text

    both = sector.isNotNull() & industry.isNotNull()
    field = [F.when(sector.isNotNull(), filled('"{sector}" sector recent news')), F.when(industry.isNotNull(), filled('"{industry}" industry recent news')), F.when(both, filled('"{industry}" supply chain regulation trends')), F.when(sector.isNull() & industry.isNull(), filled("{ticker} industry peers recent news"))]
    kinds = {
        "company": [filled('"{company}" {ticker} latest news'), filled('"{company}" earnings guidance product regulatory management')],
        "primary_source": [filled('"{company}" investor relations'), filled('"{company}" newsroom press release'), filled("{ticker} press release")],
        "industry": field, "exchange": [filled(t) for t in exchange], "regulatory": [filled(t) for t in filings],
    }
    limits = {"company": max(1, most // 3), "primary_source": 3, "industry": 3, "exchange": 2, "regulatory": most}

    def kept(kind: str, queries: list[Column]) -> Column:
        asked = F.filter(F.transform(F.array(*[q.cast("string") for q in queries]), _trimmed), lambda q: q.query.isNotNull() & (q.query != "") & ~q.low.rlike("|".join(banned)))
        once = F.aggregate(asked, F.array().cast("array<struct<query:string,low:string>>"), lambda have, q: F.when(F.exists(have, lambda h: h.low == q.low), have).otherwise(F.array_append(have, q)))
        return F.transform(F.slice(once, 1, max(0, limits[kind])), _numbered(kind))

    # each query is filled and folded once; what the kinds before leave of the budget is a slice of all
    return df.select(*keys, F.inline(F.slice(F.concat(*[kept(k, kinds[k] or [F.lit(None)]) for k in limits]), 1, max(1, most))))


def _trimmed(q: Column) -> Column:
    return F.struct(F.trim(q).alias("query"), F.lower(F.trim(q)).alias("low"))


def _numbered(kind: str):
    return lambda q, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), q.query.alias("query"))
