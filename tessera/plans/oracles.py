"""SQL for the queries of the catalogue, written on its own from the operators' definitions, for DuckDB."""

PRICES = """prices AS (
  SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
  FROM lineitem GROUP BY ALL
), own AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC, close DESC) - 1 AS back FROM prices WHERE close IS NOT NULL)"""
BENCH = """bench AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close
  FROM lineitem GROUP BY ALL
)"""
FACTS = """placed AS (
  SELECT o_orderkey, c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey
), sums AS (SELECT entity, fy, round(CAST(sum(total) AS DOUBLE), 2) AS revenue, CAST(count(*) AS DOUBLE) AS orders FROM placed GROUP BY ALL
), costs AS (
  SELECT entity, fy, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE), 2) AS discounts,
         round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE), 2) AS taxes, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS gross
  FROM lineitem JOIN placed ON l_orderkey = o_orderkey GROUP BY ALL
), facts AS (SELECT entity, fy, revenue, orders, gross, discounts, taxes FROM sums LEFT JOIN costs USING (entity, fy)
), cash AS (
  SELECT entity, fy, gross - discounts AS cash_flow, taxes AS capex, CASE WHEN fy % 2 = 0 THEN discounts END AS short_debt, CASE WHEN entity % 3 > 0 THEN taxes END AS long_debt, revenue AS equity FROM facts
)"""
FEED = "feed AS (SELECT event_id, user_id AS entity, event_type AS event_class, ts, CAST(ts AS DATE) AS date, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
TREND = f"""{PRICES}, agg AS (
  SELECT instrument, count(*) AS points, max(close) FILTER (back = 0) AS last_close, max(close) FILTER (back = 21) AS c21, max(close) FILTER (back = 63) AS c63, max(close) FILTER (back = 126) AS c126,
         CASE WHEN count(*) >= 50 THEN avg(close) FILTER (back < 50) END AS ma50, CASE WHEN count(*) >= 200 THEN avg(close) FILTER (back < 200) END AS ma200
  FROM own GROUP BY instrument
), moves AS (
  SELECT instrument, points, last_close, ma50, ma200, round((last_close / nullif(c21, 0) - 1) * 100, 2) AS return_1m, round((last_close / nullif(c63, 0) - 1) * 100, 2) AS return_3m, round((last_close / nullif(c126, 0) - 1) * 100, 2) AS return_6m,
         round((last_close / nullif(ma50, 0) - 1) * 100, 2) AS pct_above_ma50, round((last_close / nullif(ma200, 0) - 1) * 100, 2) AS pct_above_ma200
  FROM agg
), gated AS (
  SELECT instrument, points, last_close, CASE WHEN points >= 30 THEN return_1m END AS return_1m, CASE WHEN points >= 30 THEN return_3m END AS return_3m, CASE WHEN points >= 30 THEN return_6m END AS return_6m,
         CASE WHEN points >= 30 THEN pct_above_ma50 END AS pct_above_ma50, CASE WHEN points >= 30 THEN pct_above_ma200 END AS pct_above_ma200
  FROM moves
), voted AS (
  SELECT *, coalesce(CASE WHEN return_1m > 2 THEN 1 WHEN return_1m < -2 THEN -1 END, 0) + coalesce(CASE WHEN return_3m > 2 THEN 1 WHEN return_3m < -2 THEN -1 END, 0) + coalesce(CASE WHEN return_6m > 2 THEN 1 WHEN return_6m < -2 THEN -1 END, 0)
         + coalesce(sign(pct_above_ma50), 0) + coalesce(sign(pct_above_ma200), 0) AS votes FROM gated
), trend AS (
  SELECT instrument, points, last_close, return_1m, return_3m, return_6m, pct_above_ma50, pct_above_ma200,
         CASE WHEN coalesce(return_1m, return_3m, return_6m, pct_above_ma50, pct_above_ma200) IS NULL THEN 'insufficient' WHEN votes > 0 THEN 'positive' WHEN votes < 0 THEN 'negative' ELSE 'neutral' END AS momentum_label
  FROM voted
)"""
_TIER = "CASE event_class WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 WHEN 'error' THEN 5 ELSE 6 END"


def _coverage(entity: str) -> str:
    return f"""SELECT entity, n, last_date, CASE WHEN date_diff('day', last_date, DATE '2024-01-31') > 14 THEN 'stale' WHEN low <= 2 THEN 'filings_only' WHEN t1 AND t2 AND rep >= 2 THEN 'strong' WHEN rep >= 1 AND (t1 OR t2) THEN 'adequate' ELSE 'limited' END AS coverage_status
      FROM (SELECT entity, count(*) AS n, max(date) AS last_date, bool_or(t = 1) AS t1, bool_or(t = 2) AS t2, count(*) FILTER (t BETWEEN 3 AND 4) AS rep, max(t) AS low FROM (SELECT {entity} AS entity, date, {_TIER} AS t FROM feed) GROUP BY entity)"""


_SUMMARY = "count(*) FILTER (event_class = 'purchase') AS n_purchase, count(*) FILTER (event_class = 'signup') AS n_signup, count(*) FILTER (event_class = 'click') AS n_click, count(*) FILTER (event_class = 'view') AS n_view, count(*) FILTER (event_class = 'error') AS n_error"
SCORED = f"""{TREND}, {FACTS}, {FEED}, cover AS ({_coverage('entity % 25')}), tally AS (SELECT entity % 25 AS entity, {_SUMMARY} FROM feed GROUP BY 1
), signals AS (
  SELECT trend.*, s_nationkey AS entity, s_acctbal, round(gross / nullif(revenue, 0) * 100, 2) AS gross_margin, round(discounts / nullif(gross, 0) * 100, 2) AS discount_rate, round(taxes / nullif(gross, 0) * 100, 2) AS tax_rate, coalesce(coverage_status, 'none_found') AS coverage_status,
         (coalesce(n_view, 0) + coalesce(n_click, 0) + coalesce(n_purchase, 0) + coalesce(n_signup, 0) + coalesce(n_error, 0)) % 11 AS events, coalesce(n_view, 0) % 5 AS aggregators, coalesce(n_click, 0) % 5 AS high, coalesce(n_purchase, 0) % 5 AS prim, coalesce(n_signup, 0) % 6 AS press, coalesce(n_error, 0) % 6 AS weak, instrument % 7 AS warnings, instrument % 12 AS missing_count, instrument % 4 AS blocking_count
  FROM trend JOIN supplier ON instrument = s_suppkey LEFT JOIN (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity ORDER BY fy DESC) = 1) f ON f.entity = s_nationkey LEFT JOIN cover ON cover.entity = s_nationkey LEFT JOIN tally ON tally.entity = s_nationkey
), scored AS (
  SELECT *,
    CASE WHEN momentum_label = 'insufficient' THEN 0.0 ELSE round(round(greatest(0.0, least(100.0, CASE momentum_label WHEN 'positive' THEN 65.0 WHEN 'neutral' THEN 45.0 WHEN 'negative' THEN 25.0 ELSE 40.0 END
      + greatest(-30.0, least(30.0, coalesce((coalesce(return_1m, 0) + coalesce(return_3m, 0) + coalesce(return_6m, 0)) / nullif((return_1m IS NOT NULL)::INT + (return_3m IS NOT NULL)::INT + (return_6m IS NOT NULL)::INT, 0), 0.0))) * 0.5
      + CASE WHEN pct_above_ma50 > 0 THEN 5 ELSE 0 END + CASE WHEN pct_above_ma200 > 0 THEN 5 ELSE 0 END)), 6), 1) END::DOUBLE AS momentum_score,
    round(greatest(0.0, least(100.0, CASE coverage_status WHEN 'strong' THEN 75 WHEN 'adequate' THEN 60 WHEN 'filings_only' THEN 45 WHEN 'limited' THEN 35 WHEN 'stale' THEN 20 WHEN 'none_found' THEN 5 ELSE 10 END + least(events, 8) * 2 + least(high * 4, 12) + least(prim * 3, 12) + least(press * 2, 8) - least(weak * 2, 8) - least(warnings, 3) * 2)), 1)::DOUBLE AS catalyst_score,
    CASE WHEN gross_margin IS NULL THEN 0.0 ELSE round(greatest(0.0, least(100.0, 45 + 7 * ((gross_margin IS NOT NULL)::INT + (discount_rate IS NOT NULL)::INT + (tax_rate IS NOT NULL)::INT) + 8 * (return_6m IS NOT NULL)::INT + 5 * (last_close IS NOT NULL)::INT + 4 * (pct_above_ma200 IS NOT NULL)::INT - CASE WHEN instrument % 3 = 0 THEN 15 ELSE 0 END)), 1) END::DOUBLE AS fundamentals_score,
    CASE WHEN prim > 0 AND weak = 0 THEN 'strong' WHEN prim > 0 THEN 'adequate' WHEN weak > 0 THEN 'weak' ELSE 'insufficient' END AS source_quality,
    round(greatest(0.0, least(100.0, CASE WHEN prim > 0 AND weak = 0 THEN 80 WHEN prim > 0 THEN 55 WHEN weak > 0 THEN 35 ELSE 15 END + least(prim * 3, 12) - least(weak * 2, 8) - least(aggregators * 3, 12) + CASE WHEN prim > 0 THEN 8 ELSE 0 END)), 1)::DOUBLE AS source_quality_score,
    (100.0 - least(missing_count * 3, 60) - least(blocking_count * 10, 40))::DOUBLE AS completeness_score,
    least(CASE WHEN instrument % 17 = 0 THEN 25 ELSE 0 END + CASE WHEN instrument % 13 = 0 THEN 20 ELSE 0 END + CASE WHEN points < 30 THEN 8 ELSE 0 END + CASE WHEN gross_margin IS NULL THEN 8 ELSE 0 END + CASE WHEN events = 0 THEN 5 ELSE 0 END + CASE WHEN s_acctbal < 0 THEN 4 ELSE 0 END + least(warnings, 5), 40)::DOUBLE AS risk_penalty
  FROM signals
), candidates AS (
  SELECT *, round(round(greatest(0.0, least(100.0, momentum_score * 0.30::DOUBLE + catalyst_score * 0.25::DOUBLE + fundamentals_score * 0.20::DOUBLE + source_quality_score * 0.15::DOUBLE + completeness_score * 0.10::DOUBLE - risk_penalty)), 6), 1) AS candidate_score FROM scored
), graded AS (
  SELECT *, CASE WHEN instrument % 17 = 0 OR instrument % 13 = 0 OR (gross_margin IS NULL AND points < 30 AND events = 0) THEN 'data_insufficient' WHEN candidate_score >= 65 THEN 'high_internal_interest' WHEN candidate_score >= 40 THEN 'medium_internal_interest' ELSE 'low_internal_interest' END AS grade FROM candidates
)"""
PEOPLE = "people AS (SELECT customer.*, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
NEWEST = "newest AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"
SCORE_CARD = ["source_quality", "completeness", "theme", "business", "financial", "valuation", "growth", "catalyst"]
_WEIGHTS = [0.20, 0.18, 0.15, 0.12, 0.12, 0.10, 0.08, 0.05]
_CARD = " + ".join(f"((p_partkey * {i + 3} + p_size * 7) % 101) * {w}::DOUBLE" for i, w in enumerate(_WEIGHTS))
_FIELDS = ["price", "revenue", "income", "debt", "cash", "shares"]
_COUNT = lambda fs: " + ".join(f"(p_size % {_FIELDS.index(f) + 2} > 0)::INT" for f in fs)
_JUDGE = {"evidence": 3, "risk_coverage": 5, "completeness": 7, "outcome": 11}


def _hits(words: list[str], low: str = "low") -> str:
    return "(" + " + ".join(f"contains({low}, '{w}')::INT" for w in words) + ")"


_CLASSES = {"financial": ["revenue", "profit", "margin", "income"], "risk": ["risk", "worthless", "threat"], "business": ["market", "product", "blend"]}
_HINTS = {"en": ["the", "and", "of", "to", "in", "is"], "fr": ["le", "la", "les", "des", "et", "que"], "de": ["der", "die", "und", "den", "von", "mit"], "es": ["el", "los", "las", "que", "por", "una"]}
_FIGURES = ["revenue", "operating profit", "net income", "margin", "cash flow", "total assets"]
_SEGMENTS = ["segment", "by business", "by division", "by region", "business area", "business group", "business unit"]
_STATED = ["financial highlights", "income statement", "cash flow statement", "balance sheet", "financial review"]
_REPORTED = ["year ended", "months ended", "month ended", "for the year"]


def _relevance(text: str) -> str:
    has = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
    clauses = rf"list_filter(regexp_split_to_array(lower({text}), '[;!?\n]|\.\s'), lambda c: regexp_matches(c, '[€£$]\s?\d|\d\s?%|\d\s?(?:million|billion|thousand|bn|mn|m)\b'))"
    found = f"CASE WHEN {has(f'lower({text})', _FIGURES)} THEN " + " + ".join(f"(len(list_filter({clauses}, lambda c: contains(c, '{f}'))) > 0)::INT" for f in _FIGURES) + " ELSE 0 END"
    low = f"(' ' || lower({text}) || ' ')"
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    score = rf"""({_hits([w for ws in _CLASSES.values() for w in ws], low)} + 6 * ({found}) + CASE WHEN {found} > 0 AND {has(low, _SEGMENTS)} THEN 3 ELSE 0 END
        + CASE WHEN {has(low, _STATED)} THEN 2 ELSE 0 END + CASE WHEN regexp_matches({text}, '(?:^|\D)(?:19|20)\d\d(?:\D|$)') OR {has(low, _REPORTED)} THEN 1 ELSE 0 END)"""
    listed = rf"len(list_filter({lines}, lambda x: (length(x) <= 75 AND regexp_matches(x, '(?:^|\s)\d{{1,4}}$')) OR regexp_matches(x, '^\d{{1,3}}\.(?:\s|$)')))"
    return f"CASE WHEN len({lines}) >= 4 AND {listed} >= 0.6 * len({lines}) THEN greatest({score} - 8, 0) ELSE {score} END"


_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents)"
_NORMAL_URL = r"""rtrim(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) || substr(bare, length(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) + 1), '/')"""
_URLS = rf"""cut AS (SELECT page_id, url, split_part(trim(url), '#', 1) AS u FROM pages
), kept AS (SELECT page_id, url, split_part(u, '?', 1) AS base, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_|fbclid|gclid|mc_|ref)')) AS q FROM cut
), bares AS (SELECT page_id, url, CASE WHEN len(q) = 0 THEN base ELSE base || '?' || array_to_string(q, '&') END AS bare FROM kept
), urls AS (SELECT page_id, url, {_NORMAL_URL} AS norm FROM bares)"""
_FORBID = [("rating", r"\b(?:BUY|SELL|HOLD)\b"), ("rating_in_context", r"(?i)\b(?:recommend|rated|rating)\b[^.!?]{0,40}\b(?:buy|sell|hold)\b"), ("phrase", r"(?i)price target|guaranteed return|worthless")]


def _scan(x: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{n}' END" for n, p in _FORBID) + "], lambda v: v IS NOT NULL), ',')"


def _neutral(x: str) -> str:
    for p, r in [(r"(?i)price targets?", "valuation reference"), (r"(?i)guaranteed returns?", "expected outcome"), (r"(?i)worthless", "low value"), (r"\b(?:BUY|SELL|HOLD)\b", "[removed]")] + [(r"(?i)(\b(?:recommend|rated|rating)\b[^.!?]{0,40}?)\b(?:buy|sell|hold)\b", r"\1[removed]")] * 3:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


def _asof(rel: str, on: str, when: str) -> str:
    return f"(SELECT max_by(close, date) FROM {rel} b WHERE {on} b.date <= {when})"


SQL = {
    "trend_signals": f"WITH {TREND} SELECT * FROM trend",
    "period_returns": f"WITH {TREND} SELECT instrument, return_1m, return_3m, return_6m FROM moves",
    "moving_averages": f"WITH {TREND} SELECT instrument, last_close, round(ma50, 2) AS ma50, round(ma200, 2) AS ma200, pct_above_ma50, pct_above_ma200 FROM moves",
    "relative_strength": f"""WITH {PRICES}, {BENCH}, ref AS (SELECT *, row_number() OVER (ORDER BY date DESC, close DESC) - 1 AS back FROM bench),
        steps AS (SELECT instrument, least(63, count(*) - 1, (SELECT count(*) - 1 FROM ref)) AS steps FROM own GROUP BY instrument)
        SELECT instrument, CAST(steps AS BIGINT) AS steps, round((a.close / nullif(b.close, 0)) / (x.close / nullif(y.close, 0)), 3) AS relative_strength
        FROM steps JOIN own a USING (instrument) JOIN own b USING (instrument) JOIN ref x ON x.back = 0 JOIN ref y ON y.back = steps WHERE a.back = 0 AND b.back = steps AND steps > 5""",
    "week52_extremes": f"""WITH {PRICES}, w AS (SELECT *, max(date) OVER (PARTITION BY instrument) AS last FROM prices), r AS (SELECT * FROM w WHERE date >= last - 365)
        SELECT instrument, max(close) AS week52_high, min(date) FILTER (close = hi) AS high_date, min(close) AS week52_low, min(date) FILTER (close = lo) AS low_date, date_diff('day', min(date), max(date)) < 300 AS short_span
        FROM (SELECT *, max(close) OVER (PARTITION BY instrument) AS hi, min(close) OVER (PARTITION BY instrument) AS lo FROM r) GROUP BY instrument""",
    "latest_close": f"WITH {PRICES} SELECT instrument, min(date) AS first_date, max(date) AS last_date, count(*) AS points, max_by(close, date) AS last_close, max_by(volume, date) AS last_volume FROM prices GROUP BY instrument",
    "horizon_return": f"""WITH {PRICES}, {BENCH}, asked AS (SELECT DISTINCT instrument, CAST(date_trunc('year', date) AS DATE) AS start FROM prices), spans AS (SELECT *, start + 90 AS end_ FROM asked),
        v AS (SELECT s.*, {_asof('prices', 'b.instrument = s.instrument AND', 's.start')} AS p0, {_asof('prices', 'b.instrument = s.instrument AND', 's.end_')} AS p1, {_asof('bench', '', 's.start')} AS r0, {_asof('bench', '', 's.end_')} AS r1 FROM spans s),
        m AS (SELECT *, round((p1 / nullif(p0, 0) - 1) * 100, 2) AS a, round((r1 / nullif(r0, 0) - 1) * 100, 2) AS b FROM v)
        SELECT instrument, start, end_ AS "end", a AS asset_return, b AS benchmark_return, round(a - b, 2) AS relative_return FROM m""",
    "status_histogram": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders",
    "run_summary": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS n, max(o_totalprice) AS top_total FROM orders GROUP BY 1",
    "run_status": """SELECT *, CASE WHEN n_failed = n THEN 'failed' WHEN n_failed + n_warned > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS run_status FROM (
        SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice < 2000) AS n_failed, count(*) FILTER (o_orderstatus = 'P') AS n_warned FROM orders GROUP BY 1)""",
    "candidate_filter_page": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 9000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10",
    "latest_per_entity": f"WITH {NEWEST} SELECT c_custkey AS o_custkey, c_name, o_orderkey, o_totalprice, CASE WHEN o_orderkey IS NULL THEN 'not_scored' ELSE 'scored' END AS status FROM customer LEFT JOIN newest ON c_custkey = o_custkey",
    "rank_in_run": "SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS INTEGER) AS rank FROM customer",
    "round_robin_topk": """WITH a AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS round FROM orders),
        b AS (SELECT *, min(ordinal) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round, first) AS place FROM b)
        SELECT o_custkey, o_orderpriority, o_orderkey, CAST(ordinal AS INTEGER) AS ordinal, CAST(round AS INTEGER) AS round, CAST(place AS INTEGER) AS place FROM c WHERE place <= 6""",
    "category_cap_topk": """WITH a AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS in_category FROM orders),
        b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM a WHERE in_category <= 2)
        SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, CAST(in_category AS INTEGER) AS in_category, CAST(place AS INTEGER) AS place FROM b WHERE place <= 5""",
    "capped_universe": "SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank, count(*) OVER (PARTITION BY c_nationkey) > 20 AS cut FROM customer) WHERE rank <= 20",
    "evidence_pack_budget": """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
        walk AS (SELECT o_custkey, o_orderkey, size, i, size AS used, 1 AS n, TRUE AS kept FROM o WHERE i = 1
          UNION ALL SELECT o.o_custkey, o.o_orderkey, o.size, o.i, CASE WHEN used + o.size <= 400000 AND n < 8 THEN used + o.size ELSE used END, CASE WHEN used + o.size <= 400000 AND n < 8 THEN n + 1 ELSE n END, used + o.size <= 400000 AND n < 8
          FROM walk JOIN o ON o.o_custkey = walk.o_custkey AND o.i = walk.i + 1)
        SELECT o_custkey, o_orderkey, size, 'E' || n AS label FROM walk WHERE kept""",
    "identifier_ranking": """WITH s AS (SELECT s_nationkey, s_suppkey, round(s_acctbal / 10000, 4) AS confidence FROM supplier), r AS (SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS second FROM s WINDOW w AS (PARTITION BY s_nationkey ORDER BY confidence DESC, s_suppkey))
        SELECT s_nationkey, s_suppkey, confidence, second, coalesce(round(confidence - second, 6) < 0.1, FALSE) AS ambiguous FROM r WHERE n = 1""",
    "freshest_fact": """WITH f AS (SELECT c_nationkey AS entity, o_orderpriority = '1-URGENT' AS form_annual, CASE WHEN o_orderstatus <> 'P' THEN CAST(dayofyear(o_orderdate) AS INTEGER) END AS days, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderdate AS DATE) AS period_end, o_orderkey AS alias, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY entity ORDER BY form_annual DESC, coalesce(days >= 300, TRUE) DESC, fy DESC, filed DESC, period_end DESC, alias ASC, value DESC) = 1""",
    "yoy_growth": f"""WITH {FACTS} SELECT a.entity, a.fy, round((a.revenue - b.revenue) / nullif(abs(b.revenue), 0) * 100, 2) AS revenue_yoy, round((a.gross - b.gross) / nullif(abs(b.gross), 0) * 100, 2) AS gross_yoy, round((a.orders - b.orders) / nullif(abs(b.orders), 0) * 100, 2) AS orders_yoy
        FROM facts a LEFT JOIN facts b ON a.entity = b.entity AND b.fy = a.fy - 1""",
    "margins": f"WITH {FACTS} SELECT entity, fy, round(gross / nullif(revenue, 0) * 100, 2) AS gross_margin, round(discounts / nullif(gross, 0) * 100, 2) AS discount_rate, round(taxes / nullif(gross, 0) * 100, 2) AS tax_rate FROM facts",
    "free_cash_flow": f"""WITH {FACTS}, d AS (SELECT *, CASE WHEN short_debt IS NOT NULL OR long_debt IS NOT NULL THEN coalesce(short_debt, 0) + coalesce(long_debt, 0) END AS debt FROM cash)
        SELECT entity, fy, round(cash_flow - capex, 2) AS free_cash_flow, round(debt, 2) AS total_debt, round(debt / nullif(equity, 0), 3) AS debt_to_equity, (short_debt IS NULL) <> (long_debt IS NULL) AS partial_debt FROM d""",
    "datapoints_unpivot": f"WITH {FACTS}, c AS (SELECT entity, fy, cash_flow, capex, short_debt, long_debt FROM cash) SELECT entity, fy, field, round(value, 2) AS value, 'money' AS unit FROM (UNPIVOT c ON cash_flow, capex, short_debt, long_debt INTO NAME field VALUE value)",
    "market_metrics": f"""WITH {PRICES}, l AS (SELECT instrument, max_by(close, date) AS close, count(*) AS shares FROM prices GROUP BY 1), m AS (SELECT *, round(close * shares, 2) AS cap FROM l JOIN supplier ON instrument = s_suppkey)
        SELECT instrument, cap AS market_cap, round(cap + coalesce(CASE WHEN s_nationkey > 5 THEN s_acctbal * 2 END, 0) - 100, 2) AS enterprise_value,
               CASE WHEN s_acctbal > 1000 THEN round(cap / s_acctbal, 2) WHEN s_acctbal / 100 > 0 THEN round(close / (s_acctbal / 100), 2) END AS pe_ratio FROM m""",
    "staleness": f"WITH {FACTS} SELECT entity, max(fy) AS fy, max(fy) < 2002 AS stale_signal, max(fy) < 2001 AS stale_normaliser FROM facts GROUP BY entity",
    "component_scores": f"WITH {SCORED} SELECT instrument, momentum_score, catalyst_score, fundamentals_score, source_quality, source_quality_score, completeness_score, risk_penalty FROM scored",
    "candidate_score": f"""WITH {SCORED} SELECT instrument, candidate_score, grade, array_to_string(list_filter(['internal_research_candidate', 'needs_human_review', CASE WHEN momentum_label = 'positive' THEN 'positive_momentum_candidate' END, CASE WHEN coverage_status IN ('strong', 'adequate') OR events >= 3 THEN 'catalyst_rich_candidate' END, CASE WHEN gross_margin IS NOT NULL THEN 'fundamentals_available' END, CASE WHEN instrument % 17 = 0 OR instrument % 13 = 0 OR missing_count >= 8 THEN 'data_sparse' END, CASE WHEN grade = 'data_insufficient' THEN 'research_incomplete' END], lambda x: x IS NOT NULL), ',') AS labels FROM graded""",
    "combined_score": f"""WITH {SCORED}, c AS (SELECT *, round(round(greatest(0.0, least(100.0, least(s_acctbal / 100, 100.0) * 0.45::DOUBLE + candidate_score * 0.35::DOUBLE + catalyst_score * 0.10::DOUBLE + source_quality_score * 0.10::DOUBLE - least(missing_count * 1.5::DOUBLE, 15))), 6), 1) AS combined_score FROM graded)
        SELECT instrument, combined_score, CASE WHEN grade = 'data_insufficient' THEN 'insufficient_data' WHEN combined_score >= 65 THEN 'high' WHEN combined_score >= 40 THEN 'medium' WHEN combined_score >= 20 THEN 'low' ELSE 'watch' END AS interest_label FROM c""",
    "scorecard": f"""WITH a AS (SELECT p_partkey, p_size % 6 + 1 AS tier, p_partkey % 11 = 0 AS mock, greatest(0, least(100, trunc(round({_CARD}, 6)) - trunc(round(p_size * 0.2::DOUBLE, 6)))) AS t FROM part),
        b AS (SELECT *, CAST(least(t, CASE WHEN mock THEN 25 ELSE [100, 90, 80, 75, 60, 30][tier] END) AS INTEGER) AS o FROM a)
        SELECT p_partkey, o AS overall_score, CASE WHEN mock THEN 'mock_only' WHEN o < 20 THEN 'rejected_by_screen' WHEN tier >= 5 AND o < 55 THEN 'needs_primary_sources' WHEN o < 35 THEN 'needs_data' WHEN o < 55 THEN 'in_research' WHEN o < 70 THEN 'analysis_ready' ELSE 'review_ready' END AS internal_status FROM b""",
    "valuation_readiness": f"""WITH c AS (SELECT p_partkey, {_COUNT(_FIELDS[:4])} AS b, {_COUNT(_FIELDS[2:])} AS d FROM part)
        SELECT p_partkey, CAST(b AS INTEGER) AS basic_fields, CAST(d AS INTEGER) AS deeper_fields, CASE WHEN d >= 3 AND b >= 3 THEN 'deeper' WHEN b >= 3 THEN 'basic' WHEN b >= 2 THEN 'partial' ELSE 'not_ready' END AS valuation_readiness FROM c""",
    "judge_score": f"""WITH j AS (SELECT p_partkey, p_size, {', '.join(f'((p_partkey * {k} + p_size) % 101) / 100 AS {n}' for n, k in _JUDGE.items())} FROM part),
        s AS (SELECT *, round(evidence * 0.35::DOUBLE + risk_coverage * 0.25::DOUBLE + completeness * 0.25::DOUBLE + outcome * 0.15::DOUBLE, 4) AS judge_score FROM j)
        SELECT p_partkey, judge_score, CASE WHEN p_size = 13 THEN 'rejected' WHEN completeness < 0.3 THEN 'incomplete' WHEN evidence < 0.3 THEN 'weak_evidence' WHEN judge_score >= 0.7 THEN 'good' WHEN judge_score >= 0.5 THEN 'fair' ELSE 'poor' END AS judge_status FROM s""",
    "backtest_summary": """SELECT c_nationkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed,
        round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) / nullif(count(*) FILTER (o_orderstatus = 'F'), 0), 2) AS mean_score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "screener": f"""WITH {PEOPLE} SELECT c_custkey, n_name, r_name, c_acctbal, CASE WHEN c_acctbal < 500 OR c_acctbal > 9000 THEN 'rejected_by_screen' ELSE 'candidate_found' END AS screen_status FROM people WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(c_name), '1')""",
    "excluded_partition": f"WITH {PEOPLE} SELECT c_custkey, CASE WHEN r_name = 'ASIA' THEN 'region' WHEN c_mktsegment = 'FURNITURE' THEN 'segment' WHEN c_acctbal < 0 THEN 'balance' ELSE 'included' END AS reason FROM people",
    "exclusion_reasons": f"WITH {PEOPLE}, r AS (SELECT CASE WHEN r_name = 'ASIA' THEN 'region' WHEN c_mktsegment = 'FURNITURE' THEN 'segment' WHEN c_acctbal < 0 THEN 'balance' ELSE 'included' END AS reason FROM people) SELECT reason, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM r",
    "presence_split": f"""WITH {NEWEST}, x AS (SELECT c_custkey AS o_custkey, [coalesce(trim(c_name), '') <> '', o_orderkey IS NOT NULL, o_totalprice IS NOT NULL, coalesce(o_totalprice > 100000, FALSE)] AS h, ['c_name', 'o_orderkey', 'o_totalprice', 'big'] AS f FROM customer LEFT JOIN newest ON c_custkey = o_custkey)
        SELECT o_custkey, array_to_string(list_filter(f, lambda v, i: h[i]), ',') AS available, array_to_string(list_filter(f, lambda v, i: NOT h[i]), ',') AS missing, CAST(len(list_filter(h, lambda v: NOT v)) AS INTEGER) AS n_missing, CAST(floor(len(list_filter(h, lambda v: v)) * 100 / 4) AS INTEGER) AS completeness FROM x""",
    "region_filter": "SELECT n_regionkey AS r_regionkey, count(*) AS nations, min(n_name) AS first_nation FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('EUROPE', 'ASIA')) GROUP BY 1",
    "semi_in_list": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "anti_missing": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "asof_latest_before": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, lag(o_orderkey) OVER w AS pk, lag(CAST(o_orderdate AS DATE)) OVER w AS pd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey))
        SELECT o_custkey, o_orderkey, CASE WHEN day - pd <= 180 THEN pk END AS reused_order, CAST(CASE WHEN day - pd <= 180 THEN day - pd END AS INTEGER) AS age_days FROM o""",
    "resolve_channels": """WITH c AS (SELECT o_custkey AS k, max(o_totalprice) AS value, 1 AS tier, 'issuer' AS channel FROM orders GROUP BY 1 HAVING max(o_totalprice) > 300000 UNION ALL SELECT c_custkey, c_acctbal, 2, 'regulator' FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, CAST(c_nationkey AS DOUBLE), 5, 'aggregator' FROM customer)
        SELECT k, min_by(value, tier) AS value, min(tier) AS tier, min_by(channel, tier) AS channel, string_agg(channel, ',' ORDER BY channel) AS channels FROM c GROUP BY k""",
    "alias_tree": "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS aliases, count(DISTINCT p_brand) AS n_aliases FROM part GROUP BY 1",
    "token_overlap": """WITH t AS (SELECT p.p_partkey, string_split(p.p_name, ' ') AS a, string_split(q.p_name, ' ') AS b FROM part p JOIN part q ON q.p_partkey + 1 = p.p_partkey)
        SELECT p_partkey, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ' ') AS both, array_to_string(list_sort(list_distinct(a || b)), ' ') AS either, list_has_any(a, b) AS overlap FROM t""",
    "event_summary": f"WITH {FEED} SELECT entity, {_SUMMARY}, count(*) AS n_events, max(date) AS last_date, count(DISTINCT date) AS days, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS value FROM feed GROUP BY entity",
    "coverage_status": f"WITH {FEED} {_coverage('entity')}",
    "class_floor_topk": f"""WITH {FEED}, a AS (SELECT *, row_number() OVER (PARTITION BY entity, event_class ORDER BY ts DESC, event_id DESC) <= 4 AS reserved FROM feed), b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY reserved DESC, ts DESC, event_id DESC) AS p FROM a)
        SELECT entity, event_class, event_id, reserved, CAST(row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM b WHERE p <= 12""",
    "multi_source": "SELECT title_key, count(DISTINCT source) AS providers, count(*) AS items FROM (SELECT source, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS title_key FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT source) >= 2",
    "news_dedup": f"WITH {FEED} SELECT event_id, entity, event_class, date, k, position FROM (SELECT *, min(event_id) OVER (PARTITION BY entity, event_class, date) AS position, row_number() OVER (PARTITION BY entity, event_class, date ORDER BY k ASC NULLS FIRST, event_id) AS n FROM feed) WHERE n = 1",
    "lookback_filters": f"WITH {FEED}, d AS (SELECT event_id, CASE WHEN event_class <> 'purchase' THEN date_diff('day', date, DATE '2024-01-31') END AS age FROM feed) SELECT event_id, age BETWEEN 0 AND 14 AS recent, coalesce(age BETWEEN -1 AND 14, TRUE) AS in_feed FROM d",
    "attempt_upsert": f"""WITH {FEED}, cur AS (SELECT entity, event_class, max(event_id) AS event_id, max_by(value, event_id) AS value FROM feed WHERE event_id % 2 = 0 GROUP BY 1, 2), inc AS (SELECT entity, event_class, max(event_id) AS event_id, max_by(value, event_id) AS value FROM feed WHERE event_id % 2 = 1 AND event_class IN ('view', 'click', 'purchase') GROUP BY 1, 2)
        SELECT coalesce(i.entity, c.entity) AS entity, coalesce(i.event_class, c.event_class) AS event_class, coalesce(i.event_id, c.event_id) AS event_id, coalesce(i.value, c.value) AS value, CASE WHEN i.entity IS NULL THEN 'kept' WHEN c.entity IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM cur c FULL JOIN inc i ON c.entity = i.entity AND c.event_class = i.event_class""",
    "fact_supersession": """WITH s AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS label, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderstatus AS st FROM orders WHERE o_orderstatus IN ('F', 'O')),
        k AS (SELECT g, list_sort(list(label || '/' || period) FILTER (st = 'F')) AS a, list_sort(list(label || '/' || period) FILTER (st = 'O')) AS b FROM s GROUP BY g), c AS (SELECT g, CASE WHEN b IS NULL THEN FALSE WHEN a IS NULL THEN TRUE ELSE a <> b END AS changed FROM k)
        SELECT g, label, period, NOT changed AS is_active, 'old' AS origin FROM s JOIN c USING (g) WHERE st = 'F' UNION ALL SELECT g, label, period, TRUE, 'new' FROM s JOIN c USING (g) WHERE st = 'O' AND changed""",
    "link_backfill": f"WITH {FEED}, r AS (SELECT event_id, entity, CASE WHEN event_class = 'view' THEN CAST(k AS BIGINT) END AS report_id FROM feed) SELECT event_id, entity, CASE WHEN report_id IS NULL AND entity % 2 = 0 THEN entity ELSE report_id END AS report_id FROM r",
    "url_normalize": f"WITH {_URLS} SELECT page_id, norm AS url FROM urls",
    "domain_extract": r"SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS domain, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1",
    "document_identity": "SELECT page_id, rtrim(lower(regexp_extract(url, '^[^?#]*')), '/') AS identity FROM pages",
    "dedup_by_url": f"WITH {_URLS}, k AS (SELECT page_id, url, starts_with(url, 'https') AS secure, regexp_replace(norm, '^https?://', '') AS key FROM urls) SELECT page_id, url, secure, position FROM (SELECT *, min(page_id) OVER (PARTITION BY key) AS position, row_number() OVER (PARTITION BY key ORDER BY secure DESC, page_id) AS n FROM k) WHERE n = 1",
    "secret_strip": r"""WITH a AS (SELECT page_id, replace(url, '://', '://user:pw@') || CASE WHEN contains(url, '?') THEN '&token=abc&q=1' ELSE '?api_key=zz&q=1' END AS u FROM pages), b AS (SELECT *, regexp_replace(u, '#.*', '') AS c FROM a),
        d AS (SELECT *, split_part(c, '?', 1) AS base, list_filter(string_split(regexp_extract(c, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(token|key|apikey|api_key|password|secret|signature|sig|auth)=')) AS q FROM b)
        SELECT page_id, replace(CASE WHEN len(q) = 0 THEN base ELSE base || '?' || array_to_string(q, '&') END, 'user:pw@', '') AS url, regexp_replace(regexp_replace(u, 'token=abc', 'token=***'), 'api_key=zz', 'api_key=***') AS shown FROM d""",
    "link_harvest": r"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS origin, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]+)', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]+)', 1), 1) - 1 AS n FROM pages),
        t AS (SELECT page_id, n, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN origin || href END AS target FROM h)
        SELECT page_id, rtrim(lower(regexp_extract(target, '^[^?#]*')), '/') AS identity, CAST(min(n) AS INTEGER) AS first FROM t WHERE target IS NOT NULL GROUP BY 1, 2""",
    "html_blocks": r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav>', ' ', 'g'), '(?is)<header\b[^>]*>.*?</header>', ' ', 'g'), '(?is)<footer\b[^>]*>.*?</footer>', ' ', 'g') AS body FROM pages),
        r AS (SELECT page_id, unnest(regexp_extract_all(body, '(?is)<(?:p|li|h[1-6]|td)\b[^>]*>(.*?)</(?:p|li|h[1-6]|td)>', 1)) AS raw FROM b), s AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS plain FROM r),
        t AS (SELECT page_id, trim(regexp_replace(plain, '\s+', ' ', 'g')) AS block FROM s)
        SELECT page_id, count(*) AS blocks, CAST(sum(length(block)) AS BIGINT) AS chars FROM t WHERE length(block) >= 40 GROUP BY 1""",
    "paragraph_blocks": r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS raw, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) - 1 AS block_no FROM documents), b AS (SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS block FROM p)
        SELECT doc_id, block_no, CAST(length(block) AS INTEGER) AS chars, md5(block) AS block_md5 FROM b WHERE length(block) >= 40""",
    "title_normalize": "SELECT doc_id, CAST(length(title) AS INTEGER) AS n_chars, md5(title) AS title_md5 FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents)",
    "exact_dedup_sha1": "SELECT substr(sha1(lower(trim(text))), 1, 16) AS hash16, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "prefix_dedup": "SELECT min(doc_id) AS doc_id, md5(p) AS prefix_md5, count(*) AS copies FROM (SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 160) AS p FROM documents WHERE text IS NOT NULL) GROUP BY p",
    "keyword_theme_match": f"WITH {_DOCS} SELECT doc_id, array_to_string(list_filter([CASE WHEN {_hits(['energy', 'grid', 'solar'])} > 0 THEN 'energy' END, CASE WHEN {_hits(['defence', 'shield', 'guard'])} > 0 THEN 'defence' END, CASE WHEN {_hits(['growth', 'expand', 'rising'])} > 0 THEN 'growth' END, CASE WHEN {_hits(['the', 'and', 'for'])} > 0 THEN 'trade' END], lambda x: x IS NOT NULL), ',') AS themes FROM docs",
    "text_classify": f"WITH {_DOCS}, c AS (SELECT doc_id, {', '.join(f'{_hits(w)} AS {n}' for n, w in _CLASSES.items())} FROM docs) SELECT doc_id, CASE WHEN financial >= 1 AND financial >= risk THEN 'financial' WHEN risk >= 1 THEN 'risk' WHEN business >= 1 THEN 'business' ELSE 'general' END AS class FROM c",
    "relevance_score": f"WITH {_DOCS} SELECT doc_id, CAST({_relevance('text')} AS INTEGER) AS relevance FROM docs",
    "language_detect": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS hint, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS bare FROM documents), w AS (SELECT doc_id, hint, bare, ' ' || lower(substr(bare, 1, 4000)) || ' ' AS low FROM d), c AS (SELECT doc_id, hint, bare, {', '.join(f"{_hits([f' {w} ' for w in ws])} AS {n}" for n, ws in _HINTS.items())} FROM w), m AS (SELECT *, greatest(en, fr, de, es) AS most FROM c
        ), t AS (SELECT *, CASE WHEN length(bare) < 40 OR most < 3 THEN NULL WHEN en = most THEN 'en' WHEN fr = most THEN 'fr' WHEN de = most THEN 'de' ELSE 'es' END AS told FROM m)
        SELECT doc_id, coalesce(told, CASE WHEN hint IN ('fr', 'de', 'es') THEN hint END, 'en') AS language, told IS NOT NULL AS content_based FROM t""",
    "safety_scan": f"WITH {_DOCS}, n AS (SELECT doc_id, text, {_neutral('text')} AS clean FROM docs) SELECT doc_id, {_scan('text')} AS hits, {_scan('clean')} AS hits_after FROM n",
    "safety_hits": r"""WITH t AS (SELECT conv_id AS id, 'turns[' || turn || '].text' AS path, text FROM conversations UNION ALL SELECT doc_id, 'text', concat_ws(' ', text, CASE WHEN doc_id % 5 = 0 THEN 'We rated it a buy. SELL Now: Guaranteed Return' END) FROM documents
        ), c AS (SELECT *, regexp_extract(text, '(?i)\b(?:recommend|rated|rating)\b[^.!?]{0,40}\b(?:buy|sell|hold)\b') AS context FROM t
        ), h AS (SELECT id, path, 'rating' AS tier, w AS term, regexp_extract(text, '\b' || w || '\b') AS matched_text FROM t, (SELECT unnest(['BUY', 'SELL', 'HOLD']) AS w)
          UNION ALL SELECT id, path, 'rating_in_context', trim(context), context FROM c UNION ALL SELECT id, path, 'phrase', w, regexp_extract(text, '(?i)' || w) FROM t, (SELECT unnest(['price target', 'guaranteed return', 'worthless']) AS w))
        SELECT * FROM h WHERE matched_text <> ''""",
    "balance_identity": f"""WITH {FACTS} SELECT entity, fy, CASE WHEN gross IS NULL OR revenue IS NULL THEN 'not_checked' WHEN abs(revenue - (gross * 0.5::DOUBLE + (revenue * (1 + (fy % 5) / 100.0::DOUBLE) - gross * 0.5::DOUBLE))) > greatest(abs(revenue) * 0.01::DOUBLE, 0.5) THEN 'excerpt_only' ELSE 'consistent' END AS identity FROM facts""",
    "neutralize_text": f"SELECT conv_id, turn, md5({_neutral('''coalesce(text, '')''')}) AS text_md5 FROM conversations",
    "year_infer": r"WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\b(?:199\d|20\d\d)\b'), lambda y: CAST(y AS INTEGER)) AS ys FROM documents) SELECT doc_id, list_max(ys) AS year FROM d",
    "number_facts": r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\w.,])(\d[\d.,]*\d%?|\d%?)', 1)) AS raw FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, CASE WHEN ends_with(raw, '%') THEN 'percent' WHEN regexp_matches(raw, '^(199\d|20\d\d)$') THEN 'year' ELSE 'number' END AS kind, rtrim(raw, '%') AS s FROM e),
        c AS (SELECT *, length(s) - length(replace(s, ',', '')) AS commas, length(s) - length(replace(s, '.', '')) AS dots FROM k),
        v AS (SELECT doc_id, kind, try_cast(CASE WHEN commas > 0 AND dots > 0 THEN CASE WHEN strpos(reverse(s), ',') < strpos(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END
          WHEN commas > 1 OR regexp_matches(s, '^\d{1,3},\d{3}$') THEN replace(s, ',', '') WHEN commas > 0 THEN replace(s, ',', '.') WHEN dots > 1 THEN replace(s, '.', '') ELSE s END AS DOUBLE) AS value FROM c)
        SELECT doc_id, kind, count(*) AS n, max(value) AS largest, min(value) <> max(value) AS ambiguous FROM v WHERE value IS NOT NULL GROUP BY 1, 2""",
    "fact_reconcile": """WITH c AS (SELECT l_partkey AS label, l_linenumber AS scope, l_returnflag AS method, l_quantity AS value, 0.5::DOUBLE + l_discount * 4 AS confidence, l_orderkey * 10 + l_linenumber AS tie FROM lineitem),
        b AS (SELECT *, row_number() OVER (PARTITION BY label, scope ORDER BY confidence DESC, tie ASC, value DESC, method DESC) AS r FROM c),
        g AS (SELECT label, scope, min(value) AS low, max(value) AS high, count(DISTINCT method) AS methods, count(*) AS n, max(confidence) FILTER (r = 1) AS conf, max(value) FILTER (r = 1) AS v FROM b GROUP BY 1, 2),
        j AS (SELECT *, high - low <= greatest(greatest(abs(high), abs(low)) * 0.01::DOUBLE, 0.5) AS agree, least(1.0::DOUBLE, conf + CASE WHEN methods > 1 THEN 0.1::DOUBLE ELSE 0 END) AS boosted FROM g)
        SELECT label, scope, n, methods, CASE WHEN NOT agree AND methods > 1 THEN 'rejected' WHEN NOT agree OR boosted < 0.6 THEN 'excerpt_only' ELSE 'validated' END AS validation, CASE WHEN agree THEN v END AS value, CASE WHEN agree THEN round(boosted, 4) END AS confidence FROM j""",
    "subtotal_check": """WITH l AS (SELECT l_orderkey, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS e FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS l_orderkey, round(e, 2) AS expected, o_totalprice AS reported, CASE WHEN e IS NULL OR o_totalprice IS NULL THEN 'not_checked' WHEN abs(e - o_totalprice) > greatest(abs(e) * 0.01::DOUBLE, 0.5) THEN 'demoted' ELSE 'consistent' END AS "check" FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "claim_coverage": """WITH c AS (SELECT DISTINCT conv_id AS claim_id, unnest([conv_id, conv_id + turn, turn * 3]) AS doc_id FROM conversations), j AS (SELECT claim_id, count(l.doc_id) AS valid, count(*) FILTER (l.doc_id IS NULL) AS invalid FROM c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1)
        SELECT claim_id, valid, invalid, CASE WHEN valid = 0 THEN 'unsupported' WHEN invalid > 0 THEN 'partly_supported' ELSE 'supported' END AS status FROM j""",
    "rollup_extra": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sessionize_extra": """WITH a AS (SELECT user_id, ts, event_id, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOURS, TRUE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a)
        SELECT user_id, session, count(*) AS n, min(event_id) AS first_event, min(ts) AS start, max(ts) AS "end" FROM b GROUP BY 1, 2""",
}
