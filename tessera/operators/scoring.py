"""Transparent scores: each is a sum of terms that columns give; missing input adds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base points of momentum labels and coverage statuses, and the weights of candidate and combined scores.
MOMENTUM_BASE = {"positive": 65, "neutral": 45, "negative": 25}
COVERAGE_BASE = {"strong": 75, "adequate": 60, "filings_only": 45, "limited": 35, "stale": 20, "none_found": 5}
CANDIDATE_WEIGHTS = {"momentum_score": 0.30, "catalyst_score": 0.25, "fundamentals_score": 0.20, "source_quality_score": 0.15, "completeness_score": 0.10}
COMBINED_WEIGHTS = {"relevance_score": 0.45, "candidate_score": 0.35, "catalyst_score": 0.10, "source_quality_score": 0.10}
SCORECARD_WEIGHTS = {"source_quality": 0.20, "completeness": 0.18, "theme": 0.15, "business": 0.12, "financial": 0.12, "valuation": 0.10, "growth": 0.08, "catalyst": 0.05}
TIER_CAPS = {"T1": 100, "T2": 90, "T3": 80, "T4": 75, "T5": 60, "T6": 30}


def lookup(table: dict, key: str, other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(key)), F.lit(other)).cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def tenth(x: Column) -> Column:
    """One place; the step over six makes ties of sums that should be exact round up on every engine."""
    return F.round(F.round(x, 6), 1)


def points(condition: Column, n: float) -> Column:
    return F.when(condition, float(n)).otherwise(0.0)


def momentum(label: str = "momentum_label", returns: tuple[str, ...] = ("return_1m", "return_3m", "return_6m"), means: tuple[str, ...] = ("pct_above_ma50", "pct_above_ma200")) -> Column:
    """Base of the label, half the clamped mean of the returns there are, five points for each mean exceeded; 0 without history."""
    there = F.filter(F.array(*returns), lambda x: x.isNotNull())
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)).otherwise(0.0)
    score = lookup(MOMENTUM_BASE, label, 40) + clamp(mean, -30.0, 30.0) * 0.5
    for m in means:
        score = score + points(F.coalesce(F.col(m) > 0, F.lit(False)), 5)
    return F.when(F.col(label) == "insufficient", 0.0).otherwise(tenth(clamp(score, 0.0, 100.0)))


def catalyst(status: str, events: str, high: str, primary: str, press: str, weak: str, warnings: str) -> Column:
    """R2: base of the coverage (10 for an unknown one), capped counts for and against; up to eight events count two each."""
    capped = lambda c, each, most: F.least(F.col(c) * float(each), F.lit(float(most)))
    score = F.when(F.col(status).isNull(), 5.0).otherwise(lookup(COVERAGE_BASE, status, 10)) + capped(events, 2, 16) + capped(high, 4, 12) + capped(primary, 3, 12) + capped(press, 2, 8) - capped(weak, 2, 8) - F.least(F.col(warnings), F.lit(3)) * 2.0
    return tenth(clamp(score, 0.0, 100.0))


def fundamentals(available: str, fields: list[str], market: dict[str, int], stale: Column) -> Column:
    """Nothing if unavailable; 45, 7 for each field there, points for market fields, less 15 if stale."""
    score = F.lit(45.0)
    for f in fields:
        score = score + points(F.col(f).isNotNull(), 7)
    for f, n in market.items():
        score = score + points(F.col(f).isNotNull(), n)
    return F.when(~F.col(available), 0.0).otherwise(tenth(clamp(score - points(stale, 15), 0.0, 100.0)))


def completeness(missing: str, blocking: str) -> Column:
    """R5."""
    return tenth(clamp(100.0 - F.least(F.col(missing) * 3.0, F.lit(60.0)) - F.least(F.col(blocking) * 10.0, F.lit(40.0)), 0.0, 100.0))


def risk_penalty(flags: dict[str, int], warnings: str) -> Column:
    """Points of the flags that hold, one for each warning up to five, at most 40 together."""
    return F.least(sum((points(F.col(f), n) for f, n in flags.items()), F.lit(0.0)) + F.least(F.col(warnings), F.lit(5)), F.lit(40.0))


def weighted(weights: dict[str, float]) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))


def candidate(
    df: DataFrame, penalty: str = "risk_penalty", failed: str = "failed", mock: str = "mock", facts: str = "has_facts", prices: str = "has_prices", events: str = "events", missing: str = "missing_count"
) -> DataFrame:
    """Weighted score less the penalty, grade, and the labels that apply, in order. Failed and mock candidates, and those without
    prices, facts and events, have insufficient data whatever their score."""
    out = df.withColumn("candidate_score", tenth(clamp(weighted(CANDIDATE_WEIGHTS) - F.col(penalty), 0.0, 100.0)))
    unfit = F.col(failed) | F.col(mock)
    nothing = unfit | (~F.col(facts) & ~F.col(prices) & (F.col(events) == 0))
    score = F.col("candidate_score")
    out = out.withColumn("grade", F.when(nothing, "data_insufficient").when(score >= 65, "high_internal_interest").when(score >= 40, "medium_internal_interest").otherwise("low_internal_interest"))
    rich = F.coalesce(F.col("coverage_status").isin("strong", "adequate"), F.lit(False)) | (F.col(events) >= 3)
    labels = [
        F.lit("internal_research_candidate"), F.lit("needs_human_review"), F.when(F.col("momentum_label") == "positive", "positive_momentum_candidate"), F.when(rich, "catalyst_rich_candidate"),
        F.when(F.col(facts), "fundamentals_available"), F.when(unfit | (F.col(missing) >= 8), "data_sparse"), F.when(nothing, "research_incomplete"),
    ]
    return out.withColumn("labels", F.array_join(F.array_compact(F.array(*labels)), ","))


def combined(df: DataFrame, missing: str = "missing_count") -> DataFrame:
    """Weighted score less 1.5 for each missing item up to 15, and a label of interest."""
    out = df.withColumn("combined_score", tenth(clamp(weighted(COMBINED_WEIGHTS) - F.least(F.col(missing) * 1.5, F.lit(15.0)), 0.0, 100.0)))
    c = F.col("combined_score")
    return out.withColumn("interest_label", F.when(F.col("grade") == "data_insufficient", "insufficient_data").when(c >= 65, "high").when(c >= 40, "medium").when(c >= 20, "low").otherwise("watch"))


def scorecard(df: DataFrame, risk: str = "risk", tier: str = "source_tier", mock: str = "is_mock") -> DataFrame:
    """Weighted dimensions less a fifth of the risk, both cut to whole points, capped by the source's tier, and the status ladder."""
    cut = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    total = cut(F.round(weighted(SCORECARD_WEIGHTS), 6)) - cut(F.round(F.col(risk) * 0.2, 6))
    capped = F.least(clamp(total, 0, 100), F.when(F.col(mock), 25.0).otherwise(lookup(TIER_CAPS, tier, 30)))
    out = df.withColumn("overall_score", capped.cast("int"))
    o = F.col("overall_score")
    weak = F.col(tier).isin("T5", "T6")
    return out.withColumn("internal_status", F.when(F.col(mock), "mock_only").when(o < 20, "rejected_by_screen").when(weak & (o < 55), "needs_primary_sources").when(o < 35, "needs_data").when(o < 55, "in_research").when(o < 70, "analysis_ready").otherwise("review_ready"))


def overall(df: DataFrame) -> DataFrame:
    """Weighted dimensions less a fifth of the risk, both cut to whole points, from 0 to 100, capped by the source's tier; a mock without
    a better source than an estimate has the lowest cap."""
    raw = F.floor(F.round(weighted(SCORECARD_WEIGHTS), 6)) - F.floor(F.round(F.coalesce(F.col("risk"), F.lit(0)) * 0.2, 6))
    cap = F.when(F.col("is_mock") & (F.col("source_tier") == "T6"), 25.0).otherwise(lookup(TIER_CAPS, "source_tier", 25))
    return df.withColumn("overall_score", F.least(clamp(raw, 0, 100), cap).cast("int"))


def candidate_status(score: Column, tier: Column, mock: Column, completeness: Column) -> Column:
    """The ladder of screened candidates."""
    return (
        F.when(mock, "not_enough_data").when(tier.isin("T5", "T6"), F.when(score >= 50, "needs_primary_sources").otherwise("not_enough_data")).when((score < 20) | (completeness < 20), "not_enough_data")
        .when(score < 35, "low_priority_research").when(score < 55, "needs_primary_sources").when(score < 70, "ready_for_deeper_analysis").otherwise("high_priority_for_human_review")
    )


def council_status(score: Column, tier: Column, mock: Column, citations: Column, quality: Column, gaps: Column) -> Column:
    """The ladder of analysed companies: mocks, failed citations or sources, weak tiers and many gaps come before the score."""
    known = F.coalesce(quality, F.lit("insufficient"))
    return (
        F.when(mock, "not_enough_data").when((F.coalesce(citations, F.lit("unknown")) == "failed") | (known == "insufficient"), "reject_due_to_data_quality").when(tier.isin("T5", "T6"), "needs_primary_sources").when(gaps > 5, "low_priority_research")
        .when((score >= 70) & known.isin("strong", "adequate"), "high_priority_for_human_review").when(score >= 55, "ready_for_deeper_analysis").when(score >= 35, "needs_primary_sources").when(score >= 20, "low_priority_research").otherwise("not_enough_data")
    )


def valuation_readiness(df: DataFrame, available: str, basic: list[str], deeper: list[str]) -> DataFrame:
    """From how many of the fields for multiples and for deeper models are available."""
    n = lambda names: F.size(F.array_intersect(F.col(available), F.array(*map(F.lit, names))))
    b, d = n(basic), n(deeper)
    status = F.when((d >= len(deeper) - 1) & (b >= len(basic) - 1), "deeper").when(b >= len(basic) - 1, "basic").when(b >= 2, "partial").otherwise("not_ready")
    return df.withColumn("basic_fields", b).withColumn("deeper_fields", d).withColumn("valuation_readiness", status)


def run_status(df: DataFrame, keys: list[str], failed: Column, warned: Column) -> DataFrame:
    """Failed if every row failed, else with warnings if any failed or warned."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"), F.count_if(warned).alias("n_warned"))
    return agg.withColumn("run_status", F.when(F.col("n_failed") == F.col("n"), "failed").when(F.col("n_failed") + F.col("n_warned") > 0, "completed_with_warnings").otherwise("completed"))


def judge(df: DataFrame) -> DataFrame:
    """0.35 evidence, 0.25 risk, 0.25 completeness, 0.15 outcome; status by falling thresholds, forbidden language first."""
    s = F.round(F.col("evidence") * 0.35 + F.col("risk_coverage") * 0.25 + F.col("completeness") * 0.25 + F.col("outcome") * 0.15, 4)
    status = F.when(F.col("forbidden"), "rejected").when(F.col("completeness") < 0.3, "incomplete").when(F.col("evidence") < 0.3, "weak_evidence").when(F.col("judge_score") >= 0.7, "good").when(F.col("judge_score") >= 0.5, "fair").otherwise("poor")
    return df.withColumn("judge_score", s).withColumn("judge_status", status)


def quality(strong: str, weak: str) -> Column:
    """Overall quality from counts of strong and weak sources."""
    s, w = F.col(strong) > 0, F.col(weak) > 0
    return F.when(s & ~w, "strong").when(s & w, "adequate").when(w, "weak").otherwise("insufficient")


def source_quality(overall: Column, strong: str, weak: str, aggregators: str, first_tiers: Column) -> Column:
    """Base of the overall quality (25 for an unknown one), 3 for each strong source up to 12, less 2 for each weak one up to 8 and 3
    for each seen through aggregators alone up to 12, and 8 if any source is of the first two tiers."""
    base = F.when(overall == "strong", 80.0).when(overall.isin("medium", "adequate"), 55.0).when(overall == "weak", 35.0).when(F.coalesce(overall, F.lit("insufficient")) == "insufficient", 15.0).otherwise(25.0)
    capped = lambda c, each, most: F.least(F.col(c) * float(each), F.lit(float(most)))
    return tenth(clamp(base + capped(strong, 3, 12) - capped(weak, 2, 8) - capped(aggregators, 3, 12) + points(first_tiers, 8), 0.0, 100.0))


#: Points of source tiers, of overall qualities and of valuation readiness; field names, sectors and terms that the dimensions look for.
TIER_QUALITY = {"T1": 95, "T2": 85, "T3": 70, "T4": 60, "T5": 40, "T6": 15}
OVERALL_QUALITY = {"strong": 90, "adequate": 65, "weak": 30, "insufficient": 10}
READINESS = {"not_ready": 5, "partial": 30, "basic": 60, "deeper": 85}
FINANCIAL_FIELDS = ["market_cap", "market_cap_usd_m", "revenue_ttm", "ebitda", "ev_ebitda", "pe_ratio", "fcf_ttm", "net_debt", "shares_outstanding"]
SECTORS = ["energy", "utilities", "materials", "industrials", "financials", "technology", "healthcare", "real estate"]
GROWTH_TERMS = ["growth", "expansion", "market share", "tailwind", "transition", "demand", "adoption", "scale", "pipeline", "backlog"]
CATALYST_TERMS = ["catalyst", "trigger", "contract", "award", "permit", "deal", "announcement", "event", "approval", "launch"]


def matches(text: Column, words: list[str]) -> Column:
    """How many of the words the lower-cased text has."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)))


def whole(x: Column) -> Column:
    """Cut to whole points; the step over six places keeps 0.29 * 100 at 29 on every engine."""
    return F.floor(F.round(x, 6)).cast("int")


def theme_points(text: Column, themes: dict[str, list[str]], base: int) -> Column:
    """15 points for each keyword of the theme that has most, and the base."""
    return F.least(F.lit(100), F.greatest(*[matches(text, words) * 15 for words in themes.values()], F.lit(0)) + base)


def _credited(base: Column) -> Column:
    """15 points for each primary fact, 45 at most, up to a primary filing's score."""
    return F.when(F.col("primary_facts") > 0, F.least(F.lit(95.0), base + F.least(F.lit(45.0), F.col("primary_facts") * 15.0))).otherwise(base)


def _business(country: Column) -> Column:
    long = lambda c, least: F.coalesce(F.length(c) >= least, F.lit(False))
    return points(long("ticker", 2), 20) + points(long("name", 3), 20) + points(long("sector", 3), 30) + points(F.coalesce(F.length(country) >= 2, F.lit(False)), 15) + points(F.coalesce(F.lower("sector").isin(SECTORS), F.lit(False)), 15)


def candidate_dimensions(df: DataFrame, themes: dict[str, list[str]], expected: list[str] = FINANCIAL_FIELDS) -> DataFrame:
    """Nine dimensions of a screened candidate from its columns source_tier, is_mock, warnings (a number), primary_facts (a number),
    available and missing (arrays of field names), reasons (an array), ticker, name, sector, country and valuation_readiness."""
    text = F.concat_ws(" ", F.concat_ws(" ", "reasons"), "name", "sector")
    n, lack = F.size("available"), F.size("missing")
    tier, mock, none = F.col("source_tier"), F.col("is_mock"), F.size("reasons") == 0
    shift = F.least(F.greatest(F.col("primary_facts"), F.lit(0)), lack)
    quality_base = F.when(mock, 5.0).otherwise(lookup(TIER_QUALITY, "source_tier", 10))
    quality_score = _credited(quality_base)
    business = _business(F.col("country"))
    have = F.size(F.array_intersect("available", F.array(*map(F.lit, expected))))
    share = whole(have * 80 / len(expected))
    strength = F.when(have == 0, 5).when(tier == "T6", F.greatest(F.lit(0), share - 20)).when(tier == "T5", F.greatest(F.lit(0), share - 10)).otherwise(F.least(F.lit(100), share + 10))
    grown = F.least(F.lit(100), matches(F.concat_ws(" ", F.concat_ws(" ", "reasons"), "sector"), GROWTH_TERMS) * 15 + 20)
    risk = F.when(mock, 40).when(tier == "T5", 20).when(tier == "T6", 35).otherwise(0) + F.least(F.lit(30), lack * 2) + F.least(F.lit(20), F.col("warnings") * 5)
    scores = {
        "source_quality": quality_score, "completeness": F.when(n + lack == 0, 0).otherwise(whole((n + shift) * 100 / F.nullif(n + lack, F.lit(0)))), "theme": F.when(none, 10).otherwise(theme_points(text, themes, 10)),
        "business": F.least(F.lit(100.0), business), "financial": strength, "valuation": lookup(READINESS, "valuation_readiness", 5), "growth": F.when(none, 10).when(tier.isin("T5", "T6"), F.least(grown, F.lit(50))).otherwise(grown),
        "catalyst": F.when(none, 10).otherwise(F.least(F.lit(100), matches(F.concat_ws(" ", "reasons"), [*CATALYST_TERMS, "milestone"]) * 20 + 15)), "risk": F.least(F.lit(100), risk),
    }
    return df.withColumns({k: v.cast("int") for k, v in scores.items()})


def analysis_dimensions(df: DataFrame, themes: dict[str, list[str]]) -> DataFrame:
    """Nine dimensions of an analysed company from overall_quality, is_mock, source_tier, n_available, n_missing, bull, tailwinds,
    headwinds and next_steps (arrays), ticker, name, sector, valuation_readiness, and the numbers primary_facts, blocking_gaps and
    valuation_blockers. Primary facts raise the source's quality and fill missing fields."""
    bull, tail, head = F.size("bull"), F.size("tailwinds"), F.size("headwinds")
    total = F.col("n_available") + F.col("n_missing")
    base = whole(F.col("n_available") * 80 / F.nullif(total, F.lit(0)))
    weak = F.coalesce(F.col("overall_quality"), F.lit("insufficient")).isin("weak", "insufficient")
    risk = F.when(F.col("is_mock"), 40).otherwise(0) + F.when(weak, 25).otherwise(0) + F.least(F.lit(20), F.col("blocking_gaps") * 5) + F.least(F.lit(15), F.col("valuation_blockers") * 5)
    shift = F.least(F.greatest(F.col("primary_facts"), F.lit(0)), F.col("n_missing"))
    scores = {
        "source_quality": _credited(F.when(F.col("is_mock"), 5.0).otherwise(lookup(OVERALL_QUALITY, "overall_quality", 10))), "completeness": F.when(total == 0, 0).otherwise(whole((F.col("n_available") + shift) * 100 / F.nullif(total, F.lit(0)))),
        "business": F.least(F.lit(100.0), _business(F.lit(None).cast("string"))), "financial": F.when(total == 0, 0).when(F.col("source_tier").isin("T5", "T6"), F.greatest(F.lit(0), base - 15)).otherwise(base),
        "theme": F.when(bull == 0, 15).otherwise(theme_points(F.concat_ws(" ", F.concat_ws(" ", "bull"), "sector"), themes, 15)),
        "growth": F.when((bull == 0) & (tail == 0), 10).otherwise(F.greatest(F.lit(5), F.least(F.lit(100), bull * 12 + tail * 10 - head * 5 + 10))),
        "catalyst": F.when(bull == 0, 10).otherwise(F.least(F.lit(100), matches(F.concat_ws(" ", F.concat_ws(" ", "bull"), F.concat_ws(" ", "next_steps")), CATALYST_TERMS) * 20 + 10)),
        "valuation": lookup(READINESS | {"ready": 80}, "valuation_readiness", 5), "risk": F.least(F.lit(100), risk),
    }
    return df.withColumns({k: v.cast("int") for k, v in scores.items()})
