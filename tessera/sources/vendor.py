"""A vendor's fundamentals document, whole: identity, highlights, valuation, shares, technicals and three yearly statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of each section the vendor's names, our names and the units; `m` marks amounts that are given in full and kept in millions.
SECTIONS = {
    "General": ("general", {"CurrencyCode": ("currency_code", "text"), "CountryISO": ("country_iso", "text"), "IPODate": ("ipo_date", "text"), "GicSector": ("gic_sector", "text"), "GicGroup": ("gic_group", "text")}),
    "Highlights": (
        "highlights",
        {
            "MarketCapitalizationMln": ("market_cap_mln", "USD_m"), "EBITDA": ("ebitda", "USD_m m"), "PERatio": ("pe_ratio", "x"), "PEGRatio": ("peg_ratio", "x"), "EarningsShare": ("earnings_share", "USD"), "ProfitMargin": ("profit_margin", "%"),
            "OperatingMarginTTM": ("operating_margin_ttm", "%"), "ReturnOnAssetsTTM": ("return_on_assets_ttm", "%"), "ReturnOnEquityTTM": ("return_on_equity_ttm", "%"), "RevenueTTM": ("revenue_ttm_mln", "USD_m m"),
            "RevenuePerShareTTM": ("revenue_per_share_ttm", "USD"), "QuarterlyRevenueGrowthYOY": ("quarterly_revenue_growth_yoy", "%"), "GrossProfitTTM": ("gross_profit_ttm_mln", "USD_m m"), "DilutedEpsTTM": ("diluted_eps_ttm", "USD"),
            "QuarterlyEarningsGrowthYOY": ("quarterly_earnings_growth_yoy", "%"), "MostRecentQuarter": ("most_recent_quarter", "text"),
        },
    ),
    "Valuation": ("valuation", {"TrailingPE": ("trailing_pe", "x"), "ForwardPE": ("forward_pe", "x"), "PriceSalesTTM": ("price_sales_ttm", "x"), "PriceBookMRQ": ("price_book_mrq", "x"), "EnterpriseValue": ("enterprise_value_mln", "USD_m m"), "EnterpriseValueRevenue": ("ev_revenue", "x"), "EnterpriseValueEbitda": ("ev_ebitda", "x")}),
    "SharesStats": ("shares", {"SharesOutstanding": ("outstanding_mln", "M shares m"), "SharesFloat": ("float_mln", "M shares m"), "PercentInsiders": ("percent_insiders", "%"), "PercentInstitutions": ("percent_institutions", "%"), "ShortRatio": ("short_ratio", "x"), "ShortPercentFloat": ("short_percent_float", "%")}),
    "Technicals": ("technicals", {"Beta": ("beta", "x"), "52WeekHigh": ("52_week_high", ""), "52WeekLow": ("52_week_low", ""), "50DayMA": ("50_day_ma", ""), "200DayMA": ("200_day_ma", "")}),
}
STATEMENTS = {
    "Income_Statement": ("income_statement", {"totalRevenue": ("total_revenue_mln", "USD_m m"), "grossProfit": ("gross_profit_mln", "USD_m m"), "operatingIncome": ("operating_income_mln", "USD_m m"), "netIncome": ("net_income_mln", "USD_m m"), "ebitda": ("ebitda_mln", "USD_m m"), "eps": ("eps", "USD"), "epsDiluted": ("eps_diluted", "USD"), "researchDevelopment": ("r_and_d_mln", "USD_m m")}),
    "Balance_Sheet": (
        "balance_sheet",
        {
            "totalAssets": ("total_assets_mln", "USD_m m"), "totalCurrentAssets": ("total_current_assets_mln", "USD_m m"), "cash": ("cash_mln", "USD_m m"), "totalLiabilities": ("total_liabilities_mln", "USD_m m"), "shortLongTermDebtTotal": ("short_long_term_debt_mln", "USD_m m"), "longTermDebtTotal": ("long_term_debt_mln", "USD_m m"),
            "totalShareholderEquity": ("total_shareholder_equity_mln", "USD_m m"), "propertyPlantEquipment": ("ppe_net_mln", "USD_m m"), "goodWill": ("goodwill_mln", "USD_m m"), "intangibleAssets": ("intangible_assets_mln", "USD_m m"), "inventory": ("inventory_mln", "USD_m m"),
        },
    ),
    "Cash_Flow": ("cash_flow", {"totalCashFromOperatingActivities": ("operating_cash_flow_mln", "USD_m m"), "capitalExpenditures": ("capex_mln", "USD_m m"), "freeCashFlow": ("free_cash_flow_mln", "USD_m m"), "totalCashFromInvestingActivities": ("investing_cash_flow_mln", "USD_m m"), "totalCashFromFinancingActivities": ("financing_cash_flow_mln", "USD_m m")}),
}

_FLAT = ", ".join(f"{s}: map<string,string>" for s in SECTIONS)
_YEARS = ", ".join(f"{s}: struct<yearly: map<string,map<string,string>>>" for s in STATEMENTS)
DOCUMENT = f"struct<{_FLAT}, Financials: struct<{_YEARS}>>"


#: Section and the vendor's name to (our name, unit, kind): `m` amounts kept in millions, `c` the market value only given in full, `t` texts.
FIELDS = {
    f"{theirs}.{their}": (name, None if unit in ("text", "") else unit.removesuffix(" m"), "t" if unit == "text" else "m" if unit.endswith(" m") else "")
    for theirs, (_, fields) in (SECTIONS | STATEMENTS).items() for their, (name, unit) in fields.items()
} | {"_cap.": ("market_cap_mln", "USD_m", "c"), "_meta.": ("raw_payload_hash", None, "t")}


def _stated(section: str, prefix: Column, values: Column) -> Column:
    """An entry (__key, __prefix, __text) for each name that a map of texts has; of equal names the first."""
    first = F.filter(F.map_entries(values), lambda e, i: F.array_position(F.map_keys(values), e.key) == i + 1)
    return F.coalesce(F.transform(first, lambda e: _entry(F.concat(F.lit(f"{section}."), e.key), prefix, e.value)), F.array().cast(_ENTRIES))


def _entry(key: Column, prefix: Column, raw: Column) -> Column:
    return F.struct(key.alias("__key"), prefix.alias("__prefix"), raw.alias("__text"))


_ENTRIES = "array<struct<__key:string,__prefix:string,__text:string>>"


def vendor_fundamentals(payloads: DataFrame, keys: list[str], payload: str, every_year: bool = False) -> DataFrame:
    """Keys, field_name, text, value and unit of every field that a document states, and a hash of the document.

    A statement's fields carry its date, or the year's key: those of the latest year, or of all. A market value only given in full is
    kept in millions. Values are texts or numbers in the document; absent, blank and unreadable ones give no row. A document that
    is no JSON has its hash alone. Nothing is shuffled: a row is made for each name that a document states, whose field is then looked up
    once, so that the work follows what a document holds, not what it might.
    """
    d = payloads.select(*keys, F.col(payload).alias("__raw"), F.from_json(F.col(payload), DOCUMENT).alias("d"))
    parts = [_stated(theirs, F.lit(ours), F.col(f"d.{theirs}")) for theirs, (ours, _) in SECTIONS.items()]
    given = F.element_at(F.col("d.Highlights"), "MarketCapitalizationMln").try_cast("double")
    parts.append(F.array(_entry(F.lit("_cap."), F.lit("highlights"), F.when(given.isNull(), F.element_at(F.col("d.Highlights"), "MarketCapitalization"))), _entry(F.lit("_meta."), F.lit("_meta"), F.sha2(F.col("__raw"), 256))))
    for theirs, (ours, _) in STATEMENTS.items():
        years = F.col(f"d.Financials.{theirs}.yearly")
        chosen = F.map_keys(years) if every_year else F.filter(F.array(F.array_max(F.map_keys(years))), lambda k: k.isNotNull())
        of = lambda k, years=years, theirs=theirs, ours=ours: _stated(theirs, F.concat(F.lit(f"{ours}."), F.coalesce(F.nullif(F.trim(F.element_at(F.element_at(years, k), "date")), F.lit("")), k)), F.element_at(years, k))
        parts.append(F.flatten(F.transform(F.coalesce(chosen, F.array().cast("array<string>")), _one(of))))
    table = payloads.sparkSession.createDataFrame([(k, *f) for k, f in FIELDS.items()], "__key string, __name string, unit string, __kind string")
    stated = d.select(*keys, F.inline(F.concat(*parts))).filter("__text IS NOT NULL").join(F.broadcast(table), "__key")  # as many rows as FIELDS has
    raw = F.nullif(F.trim("__text"), F.lit(""))
    read = stated.withColumns({"text": F.when(F.col("__kind") == "t", raw), "__number": F.when(F.col("__kind") != "t", raw.try_cast("double"))}).withColumn("__number", F.when(~F.isnan("__number"), F.col("__number")))
    value = F.when(F.col("__kind") == "m", F.round(F.col("__number") / 1e6, 4)).when(F.col("__kind") == "c", F.round(F.col("__number") / 1e6, 2)).otherwise(F.col("__number"))
    out = read.select(*keys, F.concat("__prefix", F.lit("."), "__name").alias("field_name"), "text", value.alias("value"), "unit")
    return out.filter("text IS NOT NULL OR value IS NOT NULL")


def _one(f):
    """f as a function of one argument, since transform() looks at how many there are."""
    return lambda k: f(k)
