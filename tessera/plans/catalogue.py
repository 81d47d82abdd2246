"""Queries over the given tables: each applies an operator to whole tables. SQL for each is in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.operators import events as E
from tessera.operators import fundamentals as FU
from tessera.operators import reconcile as RC
from tessera.operators import scoring as R
from tessera.operators import screening as P
from tessera.operators import selection as S
from tessera.operators import timeseries as W
from tessera.sources.tables import benchmark_prices, event_feed, facts, prices, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _money(c: str):
    return F.round(F.sum(F.col(c).cast("decimal(18,2)")).cast("double"), 2)


# --- price series


@query
def trend_signals(spark: SparkSession, sf: str) -> DataFrame:
    return W.trend_signals(prices(spark, sf))


@query
def period_returns(spark: SparkSession, sf: str) -> DataFrame:
    return W.period_returns(prices(spark, sf))


@query
def moving_averages(spark: SparkSession, sf: str) -> DataFrame:
    return W.moving_averages(prices(spark, sf)).select("instrument", "last_close", F.round("ma50", 2).alias("ma50"), F.round("ma200", 2).alias("ma200"), "pct_above_ma50", "pct_above_ma200")


@query
def relative_strength(spark: SparkSession, sf: str) -> DataFrame:
    return W.relative_strength(prices(spark, sf), benchmark_prices(spark, sf))


@query
def week52_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return W.week52_extremes(prices(spark, sf))


@query
def latest_close(spark: SparkSession, sf: str) -> DataFrame:
    return W.latest_close(prices(spark, sf))


@query
def horizon_return(spark: SparkSession, sf: str) -> DataFrame:
    """J6 from the first day of every year on."""
    p = prices(spark, sf)
    starts = p.select("instrument", F.trunc("date", "year").alias("start")).distinct()
    return W.horizon_return(starts, p, benchmark_prices(spark, sf), 90)


# --- orders and customers


@query
def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return E.status_histogram(table(spark, sf, "orders"), "o_orderstatus")


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per priority a histogram over statuses, the largest total and the number of rows."""
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in ("F", "O", "P")], F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top_total"))


@query
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return R.run_status(o, ["o_orderpriority"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 2000), F.col("o_orderstatus") == "P")


@query
def candidate_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    c = P.conjunction(table(spark, sf, "customer"), c_mktsegment="BUILDING", c_acctbal__min=0.0, c_acctbal__max=9000.0, c_nationkey=None)
    return S.page(c.select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 50, 10)


@query
def latest_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    newest = S.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return c.join(newest, "o_custkey", "left").select("o_custkey", "c_name", "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey").isNull(), "not_scored").otherwise("scored").alias("status"))


@query
def rank_in_run(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("score", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return S.rank_nulls_last(c.select("c_custkey", "c_nationkey", "score"), ["c_nationkey"], "score", "c_custkey")


@query
def round_robin_topk(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return S.round_robin(o, "o_custkey", "o_orderpriority", [F.asc("o_orderkey")], 6)


@query
def category_cap_topk(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return S.category_cap(o, "o_custkey", "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 5)


@query
def capped_universe(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return S.capped(c, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 20)


@query
def evidence_pack_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer within a budget of totals, oversize ones skipped."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("size"))
    return S.budget(o, "o_custkey", "o_orderkey", "size", 400_000, 8)


@query
def identifier_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a nation by balance as confidence."""
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") / 10000, 4).alias("confidence"))
    return S.identifiers(s, "s_nationkey", "confidence", "s_suppkey")


# --- fundamentals


@query
def freshest_fact(spark: SparkSession, sf: str) -> DataFrame:
    """F1 over orders as filed facts of a nation: urgent orders are annual forms, days are from the order's day in the year."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity")), "o_custkey")
    f = o.select("entity", (F.col("o_orderpriority") == "1-URGENT").alias("form_annual"), F.when(F.col("o_orderstatus") != "P", F.dayofyear("o_orderdate")).alias("days"), F.year("o_orderdate").alias("fy"), F.col("o_orderdate").cast("date").alias("filed"), F.col("o_orderdate").cast("date").alias("period_end"), F.col("o_orderkey").alias("alias"), F.col("o_totalprice").alias("value"))
    return FU.freshest_fact(f, ["entity"])


@query
def yoy_growth(spark: SparkSession, sf: str) -> DataFrame:
    return FU.yoy_growth(facts(spark, sf), ["revenue", "gross", "orders"])


@query
def margins(spark: SparkSession, sf: str) -> DataFrame:
    return FU.margins(facts(spark, sf))


def _cash(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("entity", "fy", (F.col("gross") - F.col("discounts")).alias("cash_flow"), F.col("taxes").alias("capex"), F.when(F.col("fy") % 2 == 0, F.col("discounts")).alias("short_debt"), F.when(F.col("entity") % 3 > 0, F.col("taxes")).alias("long_debt"), F.col("revenue").alias("equity"))


@query
def free_cash_flow(spark: SparkSession, sf: str) -> DataFrame:
    return FU.free_cash_flow(_cash(spark, sf))


@query
def datapoints_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return FU.datapoints(_cash(spark, sf), ["entity", "fy"], {"cash_flow": "money", "capex": "money", "short_debt": "money", "long_debt": "money"}).withColumn("value", F.round("value", 2))


@query
def market_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """a supplier's latest close, lines as shares, balance as income; debt and cash from discounts and taxes."""
    last = W.latest_close(prices(spark, sf)).select("instrument", F.col("last_close").alias("close"), F.col("points").alias("shares"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("instrument"), F.when(F.col("s_acctbal") > 1000, F.col("s_acctbal")).alias("net_income"), (F.col("s_acctbal") / 100).alias("eps"), F.when(F.col("s_nationkey") > 5, F.col("s_acctbal") * 2).alias("debt"), F.lit(100.0).alias("cash"))
    return FU.market_metrics(last.join(s, "instrument"))


@query
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).groupBy("entity").agg(F.max("fy").alias("fy"))
    return f.select("entity", "fy", FU.stale("fy", 2003).alias("stale_signal"), FU.stale("fy", 2003, False).alias("stale_normaliser"))


# --- scores


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier: trend, and a nation's facts and events as the company's."""
    trend = W.trend_signals(prices(spark, sf))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("instrument"), F.col("s_nationkey").alias("entity"), "s_acctbal")
    f = S.latest(FU.margins(facts(spark, sf)), ["entity"], [F.desc("fy")]).drop("fy")
    c = E.coverage(event_feed(spark, sf).withColumn("entity", F.col("entity") % 25), "2024-01-31", 14)
    counts = E.event_summary(event_feed(spark, sf).withColumn("entity", F.col("entity") % 25)).drop("last_date", "value")
    rows = trend.join(s, "instrument").join(f, "entity", "left").join(c.select("entity", "coverage_status"), "entity", "left").join(counts, "entity", "left")
    return rows.na.fill(0, [f"n_{x}" for x in E.CLASSES]).na.fill("none_found", ["coverage_status"]).withColumn("warnings", F.pmod("instrument", F.lit(7)).cast("int")).withColumn("missing_count", F.pmod("instrument", F.lit(12)).cast("int")).withColumn("blocking_count", F.pmod("instrument", F.lit(4)).cast("int"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    x = _signals(spark, sf).withColumn("momentum_score", R.momentum()).withColumn("events", F.coalesce("n_events", F.lit(0)) % 11)
    x = x.withColumn("high", F.col("n_click") % 5).withColumn("primary", F.col("n_purchase") % 5).withColumn("press", F.col("n_signup") % 6).withColumn("weak", F.col("n_error") % 6)
    x = x.withColumn("catalyst_score", R.catalyst("coverage_status", "events", "high", "primary", "press", "weak", "warnings"))
    x = x.withColumn("has_facts", F.col("gross_margin").isNotNull()).withColumn("fundamentals_score", R.fundamentals("has_facts", ["gross_margin", "discount_rate", "tax_rate"], {"return_6m": 8, "last_close": 5, "pct_above_ma200": 4}, F.pmod("instrument", F.lit(3)) == 0))
    x = x.withColumn("aggregators", F.col("n_view") % 5).withColumn("source_quality", R.quality("primary", "weak"))
    x = x.withColumn("source_quality_score", R.source_quality(F.col("source_quality"), "primary", "weak", "aggregators", F.col("primary") > 0)).withColumn("completeness_score", R.completeness("missing_count", "blocking_count"))
    x = x.withColumn("failed", F.pmod("instrument", F.lit(17)) == 0).withColumn("mock", F.pmod("instrument", F.lit(13)) == 0).withColumn("has_prices", F.col("points") >= 30)
    x = x.withColumn("no_price", ~F.col("has_prices")).withColumn("no_facts", ~F.col("has_facts")).withColumn("no_events", F.col("events") == 0).withColumn("no_identity", F.col("s_acctbal") < 0)
    return x.withColumn("risk_penalty", R.risk_penalty({"failed": 25, "mock": 20, "no_price": 8, "no_facts": 8, "no_events": 5, "no_identity": 4}, "warnings"))


@query
def component_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("instrument", "momentum_score", "catalyst_score", "fundamentals_score", "source_quality", "source_quality_score", "completeness_score", "risk_penalty")


@query
def candidate_score(spark: SparkSession, sf: str) -> DataFrame:
    return R.candidate(_scored(spark, sf)).select("instrument", "candidate_score", "grade", "labels")


@query
def combined_score(spark: SparkSession, sf: str) -> DataFrame:
    x = R.candidate(_scored(spark, sf)).withColumn("relevance_score", F.least(F.col("s_acctbal") / 100, F.lit(100.0)))
    return R.combined(x).select("instrument", "combined_score", "interest_label")


@query
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """R11, R15 over parts: dimensions from size, price and key."""
    p = table(spark, sf, "part")
    dims = {k: F.pmod(F.col("p_partkey") * (i + 3) + F.col("p_size") * 7, F.lit(101)).cast("double").alias(k) for i, k in enumerate(R.SCORECARD_WEIGHTS)}
    x = p.select("p_partkey", *dims.values(), F.col("p_size").cast("double").alias("risk"), F.concat(F.lit("T"), (F.col("p_size") % 6 + 1).cast("string")).alias("source_tier"), (F.col("p_partkey") % 11 == 0).alias("is_mock"))
    return R.scorecard(x).select("p_partkey", "overall_score", "internal_status")


@query
def valuation_readiness(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    names = ["price", "revenue", "income", "debt", "cash", "shares"]
    have = F.array_compact(F.array(*[F.when(F.col("p_size") % (i + 2) > 0, n) for i, n in enumerate(names)]))
    x = R.valuation_readiness(p.select("p_partkey", have.alias("have")), "have", names[:4], names[2:])
    return x.select("p_partkey", "basic_fields", "deeper_fields", "valuation_readiness")


@query
def judge_score(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", *[((F.col("p_partkey") * k + F.col("p_size")) % 101 / 100).alias(n) for k, n in ((3, "evidence"), (5, "risk_coverage"), (7, "completeness"), (11, "outcome"))], (F.col("p_size") == 13).alias("forbidden"))
    return R.judge(p).select("p_partkey", "judge_score", "judge_status")


@query
def backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation, completed and failed orders and the mean score of those that have one."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    score = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))
    return o.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.round(F.sum(score).cast("double") / F.nullif(F.count(score), F.lit(0)), 2).alias("mean_score"))


# --- screens and joins


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, sf, "customer").join(n, "c_nationkey")


@query
def screener(spark: SparkSession, sf: str) -> DataFrame:
    c = P.conjunction(_customers(spark, sf), c_mktsegment__in=["BUILDING", "MACHINERY"], c_name__contains="1")
    return P.cap_band(c.select("c_custkey", "n_name", "r_name", "c_acctbal"), "c_acctbal", 500.0, 9000.0)


@query
def excluded_partition(spark: SparkSession, sf: str) -> DataFrame:
    reasons = {"region": F.col("r_name") == "ASIA", "segment": F.col("c_mktsegment") == "FURNITURE", "balance": F.col("c_acctbal") < 0}
    return _customers(spark, sf).select("c_custkey", P.first_reason(reasons).alias("reason"))


@query
def exclusion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return E.status_histogram(excluded_partition(spark, sf), "reason")


@query
def presence_split(spark: SparkSession, sf: str) -> DataFrame:
    """P5, P6, G15 over customers left-joined with their newest order."""
    x = latest_per_entity(spark, sf).withColumn("big", F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice")))
    return P.presence(x, ["c_name", "o_orderkey", "o_totalprice", "big"]).select("o_custkey", "available", "missing", "n_missing", "completeness")


@query
def region_filter(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "region").filter("r_name IN ('EUROPE', 'ASIA')").select("r_regionkey")
    nations = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return P.semi(nations, wanted, ["r_regionkey"]).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.min("n_name").alias("first_nation"))


@query
def semi_in_list(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return P.semi(table(spark, sf, "customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@query
def anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return P.anti(table(spark, sf, "customer").select("c_custkey", "c_name"), seen, ["c_custkey"])


@query
def asof_latest_before(spark: SparkSession, sf: str) -> DataFrame:
    """For each order the customer's newest earlier one within 180 days."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    prev = F.lag(F.struct("day", "o_orderkey")).over(w)
    x = o.withColumn("prev", prev)
    near = F.datediff("day", "prev.day") <= 180
    return x.select("o_custkey", "o_orderkey", F.when(near, F.col("prev.o_orderkey")).alias("reused_order"), F.when(near, F.datediff("day", "prev.day")).alias("age_days"))


@query
def resolve_channels(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's value from its largest order, its balance or its nation, by strength of the channel."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("value")).filter("value > 300000").withColumn("tier", F.lit(1)).withColumn("channel", F.lit("issuer"))
    c = table(spark, sf, "customer")
    b = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("value"), F.lit(2).alias("tier"), F.lit("regulator").alias("channel"))
    n = c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("double").alias("value"), F.lit(5).alias("tier"), F.lit("aggregator").alias("channel"))
    return P.resolve_channels(o.unionByName(b).unionByName(n), ["k"], "tier", "channel")


@query
def alias_tree(spark: SparkSession, sf: str) -> DataFrame:
    return P.alias_tree(table(spark, sf, "part"), "p_type", "p_brand")


@query
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Words of neighbouring parts' names."""
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("a"))
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b"))
    i, u, o = P.overlap(F.col("a"), F.col("b"))
    return p.join(q, "p_partkey").select("p_partkey", F.array_join(i, " ").alias("both"), F.array_join(u, " ").alias("either"), o.alias("overlap"))


# --- events


@query
def event_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.event_summary(event_feed(spark, sf))


@query
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    return E.coverage(event_feed(spark, sf), "2024-01-31", 14)


@query
def class_floor_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = event_feed(spark, sf).select("entity", "event_class", "event_id", "ts")
    return S.class_floor(e, "entity", "event_class", [F.desc("ts"), F.desc("event_id")], 4, 12).select("entity", "event_class", "event_id", "reserved", "place")


@query
def multi_source(spark: SparkSession, sf: str) -> DataFrame:
    """Whole normalised texts that two sources share, by their digest."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("source", F.md5(T.normalize_title(F.col("text")).cast("binary")).alias("title"))
    return E.multi_source(d, F.col("title"), "source")


@query
def news_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user, class and day; the strongest k wins, the position is the first's."""
    e = event_feed(spark, sf)
    return E.dedupe_ranked(e, [F.col("entity"), F.col("event_class"), F.col("date")], [F.asc("k")], "event_id").select("event_id", "entity", "event_class", "date", "k", "position")


@query
def lookback_filters(spark: SparkSession, sf: str) -> DataFrame:
    """P7, P8 with the purchases undated."""
    e = event_feed(spark, sf).withColumn("day", F.when(F.col("event_class") != "purchase", F.col("date")))
    return e.select("event_id", E.within(F.col("day"), "2024-01-31", 0, 14, None).alias("recent"), E.within(F.col("day"), "2024-01-31", -1, 14, True).alias("in_feed"))


@query
def attempt_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of the month's first half, updated by the second; errors are skipped."""
    e = event_feed(spark, sf).select("entity", "event_class", "event_id", "value")
    half = F.col("event_id") % 2 == 0
    return E.upsert(e.filter(half).groupBy("entity", "event_class").agg(F.max(F.struct("event_id", "value")).alias("x")).select("entity", "event_class", "x.*"), e.filter(~half), ["entity", "event_class"], "event_id", {"event_class": ["view", "click", "purchase"]})


@query
def fact_supersession(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's set of (priority, year) in completed orders superseded by the set in open ones."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("label"), F.year("o_orderdate").alias("period"), "o_orderstatus")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus").distinct()
    return E.supersede(side("F"), side("O"), ["g"], ["label", "period"])


@query
def link_backfill(spark: SparkSession, sf: str) -> DataFrame:
    e = event_feed(spark, sf).select("event_id", "entity", F.when(F.col("event_class") == "view", F.col("k").cast("long")).alias("report_id"))
    return E.backfill(e, "report_id", F.col("entity"), F.col("entity") % 2 == 0)


# --- web addresses and documents


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url")


@query
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("page_id", T.normalize_url(F.col("url")).alias("url"))


@query
def domain_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query
def document_identity(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("page_id", T.document_identity(F.col("url")).alias("identity"))


@query
def dedup_by_url(spark: SparkSession, sf: str) -> DataFrame:
    p = _urls(spark, sf).withColumn("secure", F.col("url").startswith("https"))
    return E.dedupe_ranked(p, [F.regexp_replace(T.normalize_url(F.col("url")), "^https?://", "")], [F.desc("secure")], "page_id")


@query
def secret_strip(spark: SparkSession, sf: str) -> DataFrame:
    u = F.concat(F.replace("url", F.lit("://"), F.lit("://user:pw@")), F.when(F.col("url").contains("?"), "&token=abc&q=1").otherwise("?api_key=zz&q=1"))
    return _urls(spark, sf).select("page_id", T.strip_secrets(F.regexp_replace(u, "#.*", "")).alias("url"), T.redact(u).alias("shown"))


@query
def link_harvest(spark: SparkSession, sf: str) -> DataFrame:
    return D.links(table(spark, sf, "pages"))


@query
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return D.html_blocks(table(spark, sf, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("chars"))


@query
def paragraph_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return D.paragraphs(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "block_no", F.length("block").alias("chars"), F.md5(F.col("block").cast("binary")).alias("block_md5"))


@query
def title_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_title(F.col("text")).alias("title")).select("doc_id", F.length("title").alias("n_chars"), F.md5(F.col("title").cast("binary")).alias("title_md5"))


@query
def exact_dedup_sha1(spark: SparkSession, sf: str) -> DataFrame:
    return D.exact_sha1(table(spark, sf, "documents"), "doc_id", "text")


@query
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


@query
def prefix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return D.prefix_dedup(table(spark, sf, "documents").filter("text IS NOT NULL"), "doc_id", "text")


@query
def keyword_theme_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", D.themes(F.coalesce("text", F.lit(""))).alias("themes"))


@query
def text_classify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.classify(F.coalesce("text", F.lit("")), **D.CLASSES).alias("class"))


@query
def relevance_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", D.relevance(F.coalesce("text", F.lit(""))).alias("relevance"))


@query
def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Of every third document the declared language is the hint."""
    d = table(spark, sf, "documents").select("doc_id", T.language(F.col("text"), D.HINTS).alias("told"), F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).alias("hint"))
    language, told = T.language_or_hint(F.col("told"), F.col("hint"), ["fr", "de", "es"])
    return d.select("doc_id", language.alias("language"), told.alias("content_based"))


@query
def safety_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", *[c.alias(n) for n, c in D.safety(F.col("text")).items()])


@query
def safety_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every term found in turns and documents, with tier, matched text and path."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.concat(F.lit("turns["), F.col("turn").cast("string"), F.lit("].text")).alias("path"), "text")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("path"), F.concat_ws(" ", "text", F.when(F.col("doc_id") % 5 == 0, "We rated it a buy. SELL Now: Guaranteed Return")).alias("text"))
    return D.safety_hits(turns.unionByName(docs), ["id", "path"], "text")


@query
def balance_identity(spark: SparkSession, sf: str) -> DataFrame:
    """V5: revenue as assets, gross less discounts as liabilities, and an equity that misses by up to 4 %."""
    f = facts(spark, sf).select("entity", "fy", F.col("revenue").alias("assets"), (F.col("gross") * 0.5).alias("liabilities"), (F.col("revenue") * (1 + (F.col("fy") % 5) / 100) - F.col("gross") * 0.5).alias("equity"))
    return RC.balance_identity(f, ["entity", "fy"], "assets", "liabilities", "equity")


@query
def neutralize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(D.neutralize(F.coalesce("text", F.lit(""))).cast("binary")).alias("text_md5"))


@query
def number_facts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return D.number_facts(d, ["doc_id"], "text").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"), F.bool_or("ambiguous").alias("ambiguous"))


@query
def year_infer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_max(T.years(F.coalesce("text", F.lit("")))).alias("year"))


# --- reconciliation


@query
def fact_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """V3, V4: unit prices of a part from two ways of return as methods."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("label"), F.col("l_linenumber").alias("scope"), F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("value"), (F.lit(0.5) + F.col("l_discount") * 4).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return RC.resolve(li, ["label", "scope"], "method", "value", "confidence", "tie")


@query
def subtotal_check(spark: SparkSession, sf: str) -> DataFrame:
    """V5: lines against the order's total."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(_money("l_extendedprice").alias("lines"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice").join(li, "l_orderkey", "left").withColumn("zero", F.lit(0.0))
    return RC.subtotals(o, ["l_orderkey"], "o_totalprice", ["lines", "zero"])


@query
def claim_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation cite document ids; labelled documents are the evidence."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("claim_id"), F.array(F.col("conv_id"), F.col("conv_id") + F.col("turn"), F.col("turn") * 3).alias("cited"))
    return D.claim_coverage(c, table(spark, sf, "labels"), "doc_id")


# --- beyond the operators above: grouping sets and sessions, which Spark has built in


@query
def rollup_extra(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query
def sessionize_extra(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user with gaps of at most six hours."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS")), 1).otherwise(0)
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.min("ts").alias("start"), F.max("ts").alias("end"))
