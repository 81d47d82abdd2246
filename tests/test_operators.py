"""Edge cases of the operators that the given tables don't hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.operators import events as E
from tessera.operators import fundamentals as FU
from tessera.operators import reconcile as RC
from tessera.operators import research as RS
from tessera.operators import scoring as R
from tessera.operators import screening as P
from tessera.operators import selection as S
from tessera.operators import timeseries as W
from tessera.sources import parsers as SP


def series(spark, closes, name="a"):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(name, day + dt.timedelta(days=i), c, 1) for i, c in enumerate(closes)], "instrument string, date date, close double, volume long")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("n,label,has", [(29, "insufficient", (0, 0, 0, 0)), (30, "positive", (1, 0, 0, 0)), (63, "positive", (1, 0, 0, 1)), (64, "positive", (1, 1, 0, 1)), (127, "positive", (1, 1, 1, 1)), (200, "positive", (1, 1, 1, 1))])
def test_history_gates(spark, n, label, has):
    r = W.trend_signals(series(spark, [1.01**i for i in range(n)])).first()
    assert r.momentum_label == label and r.points == n
    assert tuple(int(r[c] is not None) for c in ("return_1m", "return_3m", "return_6m", "pct_above_ma50")) == has
    assert (r.pct_above_ma200 is not None) == (n >= 200)
    if n >= 30:
        assert r.return_1m == round((1.01**21 - 1) * 100, 2)


def test_zero_and_null_prices(spark):
    r = W.trend_signals(series(spark, [0.0] + [None] * 5 + [1.0] * 21 + [2.0])).first()
    assert r.points == 23 and r.return_1m is None
    flat = W.trend_signals(series(spark, [5.0] * 250)).first()
    assert flat.momentum_label == "neutral" and flat.return_6m == 0.0
    assert W.trend_signals(series(spark, [])).count() == 0


def test_extremes_keep_the_earliest_of_ties(spark):
    r = W.week52_extremes(series(spark, [1.0] + [3.0, 1.0] * 200 + [3.0])).first()
    assert (r.week52_high, r.week52_low, r.short_span) == (3.0, 1.0, False)
    assert r.high_date <= dt.date(2024, 2, 8) and r.low_date <= dt.date(2024, 2, 8)
    assert W.week52_extremes(series(spark, [1.0] * 100)).first().short_span


def test_relative_strength_needs_six_steps(spark):
    bench = series(spark, [1.0] * 100).select("date", "close")
    assert W.relative_strength(series(spark, [1.0] * 6), bench).count() == 0
    r = W.relative_strength(series(spark, [2.0**i for i in range(7)]), bench).first()
    assert r.steps == 6 and r.relative_strength == 64.0


def test_growth_needs_the_very_year_before(spark):
    rows = [("a", 2000, 10.0), ("a", 2001, 15.0), ("a", 2003, 30.0), ("b", 2000, 0.0), ("b", 2001, 5.0), ("c", 2000, -10.0), ("c", 2001, 10.0)]
    got = {(r.entity, r.fy): r.value_yoy for r in FU.yoy_growth(spark.createDataFrame(rows, "entity string, fy int, value double"), ["value"]).collect()}
    assert got == {("a", 2000): None, ("a", 2001): 50.0, ("a", 2003): None, ("b", 2000): None, ("b", 2001): None, ("c", 2000): None, ("c", 2001): 200.0}


def test_freshest_fact_order(spark):
    rows = [("k", False, 365, 2005, "2006-02-01", "2005-12-31", 0, 1.0), ("k", True, 90, 2004, "2005-02-01", "2004-12-31", 0, 2.0), ("k", True, None, 2003, "2004-02-01", "2003-12-31", 1, 3.0), ("k", True, 365, 2003, "2004-03-01", "2003-12-31", 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, form_annual boolean, days int, fy int, filed string, period_end string, alias int, value double")
    assert FU.freshest_fact(df, ["k"]).first().value == 4.0  # annual and full, then the amendment


def test_debt_of_parts(spark):
    df = spark.createDataFrame([(1, 2000, 5.0, 1.0, None, None, 0.0), (2, 2000, None, 1.0, 3.0, None, 2.0), (3, 2000, 1.0, None, 3.0, 4.0, 2.0)], "entity int, fy int, cash_flow double, capex double, short_debt double, long_debt double, equity double")
    got = {r.entity: (r.free_cash_flow, r.total_debt, r.debt_to_equity, r.partial_debt) for r in FU.free_cash_flow(df).collect()}
    assert got == {1: (4.0, None, None, False), 2: (None, 3.0, 1.5, True), 3: (None, 7.0, 3.5, False)}


def test_budget_skips_but_goes_on(spark):
    rows = [("a", 1, 900), ("a", 2, 50), ("a", 3, 500), ("a", 4, 40), ("b", 1, 5000), ("b", 2, 1)]
    got = {(r.k, r.o): r.label for r in S.budget(spark.createDataFrame(rows, "k string, o long, s long"), "k", "o", "s", 1000).collect()}
    assert got == {("a", 1): "E1", ("a", 2): "E2", ("a", 4): "E3", ("b", 1): "E1"}  # the first always stays


@pytest.mark.parametrize("items", [None, 3])
def test_budget_equals_the_plain_rule(spark, items):
    import random

    random.seed(8)
    rows = [(f"k{random.randrange(6)}", i, random.choice([0, 1, 7, 7, 30, 90, 400])) for i in range(900)]
    want, used, n = set(), {}, {}
    for k, o, s in rows:
        if n.get(k, 0) == 0 or (used[k] + s <= 200 and (items is None or n[k] < items)):
            used[k], n[k] = used.get(k, 0) + s, n.get(k, 0) + 1
            want.add((k, o, f"E{n[k]}"))
    got = S.budget(spark.createDataFrame(rows, "k string, o long, s long"), "k", "o", "s", 200, items)
    assert {(r.k, r.o, r.label) for r in got.collect()} == want


def test_floors_hold_against_the_newest(spark):
    rows = [("k", "a", i) for i in range(20)] + [("k", "b", -i) for i in range(1, 6)]
    got = S.class_floor(spark.createDataFrame(rows, "k string, c string, t int"), "k", "c", [F.desc("t")], 4, 10).collect()
    assert sorted(r.t for r in got if r.c == "b") == [-4, -3, -2, -1] and sorted(r.t for r in got if r.c == "a") == list(range(14, 20))
    assert [r.t for r in sorted(got, key=lambda r: r.place)] == sorted((r.t for r in got), reverse=True)


def test_round_robin_and_more_kinds_than_places(spark):
    rows = [("k", c, i) for i, c in enumerate("aaabbcdef")]
    got = S.round_robin(spark.createDataFrame(rows, "k string, c string, i int"), "k", "c", [F.asc("i")], 4).orderBy("place").collect()
    assert [r.c for r in got] == ["a", "b", "c", "d"]


def test_shared_cap(spark):
    rows = [("k", i, c) for i, c in enumerate("vvvccpvsp")]
    df = spark.createDataFrame(rows, "k string, i long, c string")
    got = RS.category_budget(df, "k", "i", "c", {}, [(["v", "c"], 2)], {"p": 1}, 5).orderBy("place").collect()
    assert [(r.i, r.c) for r in got] == [(5, "p"), (0, "v"), (1, "v"), (7, "s"), (8, "p")]


def test_scores_at_zero_and_missing(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, 5.0)], "id int, s double")
    assert [r.id for r in S.rank_nulls_last(df.withColumn("k", F.lit(1)), ["k"], "s", "id").orderBy("rank").collect()] == [3, 1, 2]
    assert value(spark, R.clamp(F.lit(140.0), 0.0, 100.0)) == 100.0


def test_supersession(spark):
    old = spark.createDataFrame([("g1", "a", 1), ("g2", "a", 1), ("g3", "a", 1)], "g string, l string, p int")
    new = spark.createDataFrame([("g1", "a", 1), ("g1", "a", 1), ("g2", "b", 1), ("g2", "b", 1), ("g4", "c", 1)], "g string, l string, p int")
    got = sorted((r.g, r.l, r.is_active, r.origin) for r in E.supersede(old, new, ["g"], ["l", "p"]).collect())
    assert got == [("g1", "a", True, "old"), ("g2", "a", False, "old"), ("g2", "b", True, "new"), ("g3", "a", True, "old"), ("g4", "c", True, "new")]


def test_reconcile(spark):
    rows = [("same", "m1", 100.0, 0.7, 1), ("same", "m2", 100.4, 0.8, 2), ("clash", "m1", 1.0, 0.9, 1), ("clash", "m2", 9.0, 0.9, 2), ("one", "m1", 1.0, 0.9, 1), ("one", "m1", 9.0, 0.9, 2), ("low", "m1", 1.0, 0.5, 1)]
    got = {r.k: (r.validation, r.value, r.confidence) for r in RC.resolve(spark.createDataFrame(rows, "k string, m string, v double, c double, t int"), ["k"], "m", "v", "c", "t").collect()}
    assert got == {"same": ("validated", 100.4, 0.9), "clash": ("rejected", None, None), "one": ("excerpt_only", None, None), "low": ("excerpt_only", 1.0, 0.5)}


def test_filters_only_add_what_is_asked(spark):
    df = spark.createDataFrame([(1, "A", 5.0), (2, "B", None), (3, None, 7.0)], "id int, s string, v double")
    assert P.conjunction(df, s=None).count() == 3
    assert [r.id for r in P.conjunction(df, v__max=6.0).collect()] == [1]  # nulls drop out
    band = {r.id: r.screen_status for r in P.cap_band(df, "v", 6.0, None).collect()}
    assert band == {1: "rejected_by_screen", 2: "candidate_found", 3: "candidate_found"}


def test_lookback_edges(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 1, 17),), (dt.date(2024, 1, 16),), (dt.date(2024, 2, 1),), (None,)], "d date")
    got = [tuple(r) for r in days.select(E.within(F.col("d"), "2024-01-31", 0, 14, None), E.within(F.col("d"), "2024-01-31", -1, 14, True)).collect()]
    assert got == [(True, True), (True, True), (False, False), (False, True), (None, True)]


@pytest.mark.parametrize(
    "raw,want",
    [("1,234", 1234.0), ("1,23", 1.23), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("1.234.567", 1234567.0), ("1,234,567", 1234567.0), ("12", 12.0), (" 3.5 ", 3.5), ("-1,5", -1.5), ("x", None), ("", None)],
)
def test_numbers(spark, raw, want):
    assert value(spark, T.number(F.lit(raw))) == want


@pytest.mark.parametrize(
    "url,want",
    [("HTTP://Host.COM/Path/?utm_source=x&b=2&ref=y#f", "http://host.com/Path/?b=2"), ("http://h/?utm_source=feed", "http://h"), ("https://h/a/", "https://h/a"), ("https://h/a?B=1&gclid=3", "https://h/a?B=1")],
)
def test_normalized_urls(spark, url, want):
    assert value(spark, T.normalize_url(F.lit(url))) == want


def test_secrets_and_identifiers(spark):
    assert value(spark, T.strip_secrets(F.lit("https://u:p@h/x?token=1&q=2&API_KEY=3#z"))) == "https://h/x?q=2"
    assert value(spark, T.cik(F.lit("CIK0000320193"))) == "0000320193" and value(spark, T.cik(F.lit("0"))) is None and value(spark, T.cik(F.lit("12345678901"))) is None
    assert value(spark, T.accession(F.lit("0000320193-24-000123"))) == "0000320193-24-000123" and value(spark, T.accession(F.lit("123"))) is None
    assert value(spark, T.item_codes(F.lit("Item 2.02, item 9.01,,"))) == ["2.02", "9.01"]
    assert value(spark, T.date_of(F.lit("Mon, 05 Feb 2024 10:00:00 GMT"))) == dt.date(2024, 2, 5) and value(spark, T.date_of(F.lit("soon"))) is None


def test_safety_words(spark):
    scan = lambda t: value(spark, D.forbidden(F.lit(t)))
    assert scan("We BUY it") == "rating" and scan("we buy it") == ""
    assert scan("They recommend that you buy") == "rating_in_context" and scan("They recommend it. You buy") == ""
    for t in ("Recommend to buy now, a guaranteed return", "BUY or SELL, price targets, worthless"):
        assert value(spark, D.forbidden(D.neutralize(F.lit(t)))) == ""


def test_short_text_has_no_language(spark):
    lang = lambda t: value(spark, T.language(F.lit(t), D.HINTS))
    assert lang("the and of to") is None
    assert lang("the house and the garden of the king in the town") == "en"
    assert lang("der hund und die katze mit dem freund von nebenan") == "de"


def test_blocks_of_forty_characters(spark):
    df = spark.createDataFrame([(1, "x" * 39 + "\n\n" + "y" * 40 + "\n"), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.block_no) for r in D.paragraphs(df, "id", "t").collect()] == [(1, 1)]


def test_bad_csv_rows(spark):
    lines = spark.createDataFrame([(1, "2024-01-02,1,2,3,4,5.0"), (2, "2024-1-2,1,2,3,4,5"), (3, "2024-01-02,1,2,3,N/D,5"), (4, "2024-01-02,x,,3,4,"), (5, "")], "id int, line string")
    got = {r.id: (r.open, r.high, r.close, r.volume) for r in SP.price_csv(lines, ["id"], "line").collect()}
    assert got == {1: (1.0, 2.0, 4.0, 5), 4: (None, None, 4.0, None)}


def test_claims_without_evidence(spark):
    claims = spark.createDataFrame([(1, [1, 2]), (2, [9]), (3, [1, 1])], "claim_id int, cited array<long>")
    got = {r.claim_id: r.status for r in D.claim_coverage(claims, spark.createDataFrame([(1,)], "doc_id long"), "doc_id").collect()}
    assert got == {1: "partly_supported", 2: "unsupported", 3: "supported"}


def test_names(spark):
    assert value(spark, RS.names_match(F.lit("Acme Inc"), F.lit("ACME Holding AG"))) and not value(spark, RS.names_match(F.lit("Acme"), F.lit("Bolt")))
    assert value(spark, RS.placeholder_name(F.lit("aapl.us"), F.lit("AAPL"))) and value(spark, RS.placeholder_name(F.lit(None).cast("string"), F.lit("X")))
    assert value(spark, RS.json_from_text(F.lit('a ```json\n{"k": 1}\n``` b'))) == '{"k": 1}' and value(spark, RS.json_from_text(F.lit("none"))) is None


def test_insert_rows_twice_adds_nothing(spark, tmp_path):
    from tessera.sources.sinks import insert_rows

    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id long, v string")
    insert_rows(rows, path, ["id"])
    insert_rows(rows.union(spark.createDataFrame([(3, "c")], "id long, v string")), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_risk_grade_and_labels_follow_the_signal(spark):
    from pyspark.sql import functions as F
    from tessera.operators import scoring as R

    rows = [("failed", True, False, True, True, 9, 0, 90.0), ("bare", False, False, False, False, 0, 9, 90.0), ("good", False, False, True, True, 4, 0, 90.0), ("some", False, False, True, False, 0, 8, 60.0)]
    x = spark.createDataFrame(rows, "name string, failed boolean, mock boolean, has_facts boolean, has_prices boolean, events int, missing_count int, s double")
    x = x.withColumns({c: F.col("s") for c in R.CANDIDATE_WEIGHTS}).withColumn("risk_penalty", F.lit(5.0)).withColumn("momentum_label", F.lit("positive")).withColumn("coverage_status", F.lit("limited"))
    got = {r.name: (r.candidate_score, r.grade, r.labels.split(",")[2:]) for r in R.candidate(x).collect()}
    assert got["failed"] == (85.0, "data_insufficient", ["positive_momentum_candidate", "catalyst_rich_candidate", "fundamentals_available", "data_sparse", "research_incomplete"])
    assert got["bare"] == (85.0, "data_insufficient", ["positive_momentum_candidate", "data_sparse", "research_incomplete"])
    assert got["good"] == (85.0, "high_internal_interest", ["positive_momentum_candidate", "catalyst_rich_candidate", "fundamentals_available"])
    assert got["some"][1:] == ("medium_internal_interest", ["positive_momentum_candidate", "fundamentals_available", "data_sparse"])


def test_source_and_catalyst_scores(spark):
    from pyspark.sql import functions as F
    from tessera.operators import scoring as R

    rows = [("medium", 5, 5, 5, False, "strong"), ("odd", 1, 0, 1, True, "odd"), (None, 0, 0, 0, False, None), ("strong", 1, 1, 0, True, "stale")]
    x = spark.createDataFrame(rows, "overall string, strong int, weak int, agg int, first boolean, coverage string")
    got = [(r.q, r.c) for r in x.select(R.source_quality(F.col("overall"), "strong", "weak", "agg", F.col("first")).alias("q"), R.catalyst("coverage", "strong", "weak", "agg", "agg", "weak", "weak").alias("c")).collect()]
    # 55+12-8-12; 25+3-3+8; 15; 80+3-2+8, and 75+10+12+12+8-8-6 (clamped); 10+2+3+2; 5; 20+2+4-2-2
    assert got == [(47.0, 100.0), (33.0, 17.0), (15.0, 5.0), (89.0, 22.0)]


def test_text_classes_and_language_fallbacks(spark):
    from pyspark.sql import functions as F
    from tessera.functions import text as T
    from tessera.operators import documents as D

    texts = ["profit at risk", "risk and threat to profit", "product", "product risk", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.classify(F.col("t"), **D.CLASSES)).collect()]
    assert got == ["financial", "risk", "business", "risk", "general"]
    rows = [("the cat and the dog went to the river in the end", "FR", "en", True), ("short", "de-AT", "de", False), (None, "xx", "en", False), ("le chat et les chiens que la dame des bois a vus, et la fin", None, "fr", True), ("  \n", "fr", "fr", False)]
    x = spark.createDataFrame(rows, "t string, hint string, want string, told boolean").withColumn("content", T.language(F.col("t"), D.HINTS))
    code, told = T.language_or_hint(F.col("content"), F.col("hint"), ["fr", "de", "es"])
    assert all(r[0] == r[2] and r[1] == r[3] for r in x.select(code, told, "want", "told").collect())


def test_labelled_facts_stay_in_their_clause(spark):
    from tessera.operators import documents as D

    texts = ["Revenue rose 5%", "Revenue rose by 5% to $1,200.5 million", "revenue fell; profit of 3 million", "Revenue for 2003 was 7 billion", "revenue but costs of 9 million", "Margin of 4.5%", "revenue was 12.5%"]
    got = D.labelled_facts(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t", {"revenue": ["revenue"]}, {"margin": ["margin"]}).collect()
    assert sorted((r.id, r.label, r.value, r.scale) for r in got) == [(1, "revenue", 1200.5, "million"), (3, "revenue", 7.0, "billion"), (5, "margin", 4.5, None)]
