"""SQL for intake_queries."""

from html import unescape
from html.entities import html5

from tessera.plans.oracles import FACTS

_FIELDS = ["market_cap", "market_cap_usd_m", "revenue_ttm", "ebitda", "ev_ebitda", "pe_ratio", "fcf_ttm", "net_debt", "shares_outstanding"]
_REASONS = ["demand for solar power is in transition", "contract award for bolt and gear supply", "product launch event", "adoption at scale", "regulator approval milestone"]
_GROWTH = ["growth", "expansion", "market share", "tailwind", "transition", "demand", "adoption", "scale", "pipeline", "backlog"]
_CATALYSTS = ["catalyst", "trigger", "contract", "award", "permit", "deal", "announcement", "event", "approval", "launch"]
def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Character references by HTML's rules, as html.unescape has them: named ones, some of which need no semicolon and then end at the longest name; numbers.
_NAMES = "MAP {" + ", ".join(f"{_quoted(n)}: {_quoted(c)}" for n, c in html5.items()) + "}"
_NUMBERS = [*range(160), *range(0xFDD0, 0xFDF0), *(plane * 0x10000 + n for plane in range(17) for n in (0xFFFE, 0xFFFF))]
_ODD = "MAP {" + ", ".join(f"{n}: {_quoted(unescape(f'&#{n};'))}" for n in _NUMBERS if n and unescape(f"&#{n};") != chr(n)) + "}"
_PIECES = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"
_CODE = "coalesce(TRY_CAST(CASE WHEN lower(p[3]) = 'x' THEN '0x' || ltrim(rtrim(substr(p, 4), ';'), '0') || CASE WHEN ltrim(rtrim(substr(p, 4), ';'), '0') = '' THEN '0' ELSE '' END ELSE rtrim(substr(p, 3), ';') END AS BIGINT), 1114112)"
_NUMBER = f"list_transform([{_CODE}], lambda n: CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) ELSE coalesce({_ODD}[n], chr(CAST(least(n, 1114111) AS INTEGER))) END)[1]"
_NAME = f"coalesce(list_filter(list_transform(range(length(p), 2, -1), lambda i: {_NAMES}[substr(p, 2, i - 1)] || substr(p, i + 1)), lambda c: c IS NOT NULL)[1], p)"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BARE = r"regexp_replace(regexp_replace(x, '(?is)<(br|img|hr|wbr|input)\b[^>]*>', ' ', 'g'), '(?s)<[^>]*>', '', 'g')"
_TAG = f"trim(regexp_replace(array_to_string(list_transform(regexp_extract_all({_BARE}, '{_PIECES}'), lambda p: CASE WHEN NOT starts_with(p, '&') OR p = '&' THEN p WHEN p[2] = '#' THEN {_NUMBER} ELSE {_NAME} END), ''), '{_SPACE}', ' ', 'g'))"


def _n(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{w}')::INT" for w in words) + ")"


def _theme(text: str, base: int) -> str:
    return f"least(100, greatest({_n(text, ['grid', 'power', 'solar'])}, {_n(text, ['bolt', 'gear', 'ring'])}) * 15 + {base})"


_LIST = "[" + ", ".join(f"'{r}'" for r in _REASONS) + "]"
_HAVE = " + ".join(f"(p_size % {i + 2} > 0)::INT" for i in range(9))
_WHY = "list_filter([" + ", ".join(f"CASE WHEN (p_partkey + {i}) % 4 = 0 THEN '{r}' END" for i, r in enumerate(_REASONS)) + "], lambda x: x IS NOT NULL)"
_PEOPLE = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_PROSE = """prose AS (
  SELECT entity, fy, 'margin' AS label, 'percent' AS kind, 4.5::DOUBLE AS value, NULL AS scale FROM facts WHERE fy % 4 = 0
  UNION ALL SELECT entity, fy, 'revenue', 'money', floor(revenue / 1000), 'thousand' FROM facts WHERE fy % 4 > 0
  UNION ALL SELECT entity, fy, 'gross', 'money', floor(gross / 1000), CASE WHEN fy % 4 = 1 THEN 'thousand' END FROM facts WHERE fy % 4 > 0 AND gross IS NOT NULL
  UNION ALL SELECT entity, fy, 'margin', 'percent', 12.0, NULL FROM facts WHERE fy % 4 > 1 AND gross IS NOT NULL)"""

SQL = {
    "vendor_filter": f"SELECT c_custkey, c_name || '.' || lower(r_name) AS symbol FROM {_PEOPLE} WHERE c_custkey % 5 <> 1 AND upper(r_name) = 'EUROPE'",
    "universe_filter": f"""WITH p AS (SELECT *, lower(c_mktsegment || ' ' || c_name || ' ' || r_name) AS t FROM {_PEOPLE})
        SELECT 'country' AS search, c_custkey, CASE WHEN n_name NOT IN ('FRANCE', 'JAPAN', 'NATION_3', 'NATION_7') THEN 'region mismatch: ' || n_name || ' not in requested FRANCE, JAPAN, NATION_3, NATION_7' WHEN contains(t, 'furniture') THEN 'excluded by keyword furniture' WHEN contains(t, '00007') THEN 'excluded by keyword 00007' END AS reason FROM p
        UNION ALL SELECT 'region', c_custkey, CASE WHEN r_name NOT IN ('ASIA', 'EUROPE') THEN 'region mismatch: ' || n_name || ' not in requested ASIA, EUROPE' WHEN contains(t, 'machinery') THEN 'excluded by keyword machinery' END FROM p""",
    "thesis_context": "SELECT s_suppkey, p_partkey, p_type AS theme FROM supplier LEFT JOIN (SELECT *, p_partkey % 40 * 2 AS k FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) = 1) ON k = s_suppkey",
    "rank_nulls_last": "SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY rank ASC NULLS LAST, c_custkey) AS INTEGER) AS place FROM (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS rank FROM customer)",
    "document_ranking": "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY least(p_size % 7, 5), p_partkey % 2, p_partkey) AS INTEGER) AS place FROM part",
    "evidence_dedup": "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END, CAST(doc_id % 50 AS VARCHAR)), coalesce(lang, ''), substr(coalesce(text, ''), 1, 60) ORDER BY doc_id) = 1",
    "freshest_alias": f"""WITH {FACTS}, filed AS (SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(max(o_orderdate) AS DATE) AS filed FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
        ), f AS (SELECT * FROM facts JOIN filed USING (entity, fy)
        ), e AS (SELECT entity, 'Revenues' AS alias, 0 AS o, fy, filed, revenue AS value FROM f WHERE fy < 1999 OR entity % 2 = 0 UNION ALL SELECT entity, 'SalesNet', 1, fy, filed, gross FROM f WHERE fy >= 1998 AND entity % 3 > 0 AND gross IS NOT NULL
        ), p AS (SELECT e.*, CASE WHEN e.entity % 5 > 0 THEN b.value END AS prior FROM e LEFT JOIN e b ON b.entity = e.entity AND b.alias = e.alias AND b.fy = e.fy - 1)
        SELECT entity, alias, fy, CASE WHEN entity % 5 > 0 THEN 'annual' ELSE 'quarterly' END AS period_type, value, prior FROM p QUALIFY row_number() OVER (PARTITION BY entity ORDER BY fy DESC, filed DESC, o) = 1""",
    "vendor_statements": f"""WITH {FACTS}, l AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity ORDER BY fy DESC) = 1)
        SELECT entity, 'market_cap_mln' AS field_name, round(entity * 1.5::DOUBLE, 4) AS value, 'USD_m' AS unit FROM l WHERE entity % 4 > 0 UNION ALL SELECT entity, 'pe_ratio', 12.5, 'ratio' FROM l WHERE entity % 3 = 0
        UNION ALL SELECT entity, 'income_statement.' || fy || '-12-31.total_revenue_mln', round(revenue / 1000000, 4), 'USD_m' FROM l WHERE fy % 3 > 0 UNION ALL SELECT entity, 'income_statement.' || fy || '-12-31.gross_profit_mln', round(gross / 1000000, 4), 'USD_m' FROM l WHERE gross IS NOT NULL""",
    "news_json": r"""WITH p AS (SELECT page_id, url, CASE WHEN regexp_matches(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#:]+\.)?example\.com([/?#:]|$)') THEN 3 WHEN regexp_matches(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#:]+\.)?example\.org([/?#:]|$)') THEN 4 ELSE 5 END AS tier FROM pages)
        SELECT page_id, 0 AS n, 't' || page_id AS headline, url, '2024-01-02' AS published_at, 'Wire' AS source_name, tier AS source_tier FROM p WHERE page_id % 3 = 0
        UNION ALL SELECT page_id, 1, 'x', 'http://www.example.com/a', NULL, 'own', 3 FROM p WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 0, 't' || page_id, url, '2024', 'House', tier FROM p WHERE page_id % 3 = 1
        UNION ALL SELECT page_id, 1, 't' || page_id, NULL, NULL, NULL, 5 FROM p WHERE page_id % 3 = 2""",
    "heading_sections": rf"""WITH t AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS tags FROM pages
        ), own AS (SELECT page_id, list_filter(list_transform(tags, lambda x: {{'level': CAST(substr(x, 3, 1) AS INTEGER), 'title': {_TAG}}}), lambda h: h.title <> '') AS hs FROM t
        ), rows AS (SELECT page_id, unnest(list_concat(hs, [{{'level': 2, 'title': 'Part ' || page_id}}, {{'level': 4, 'title': 'Deep'}}, {{'level': 3, 'title': 'Less'}}, {{'level': 2, 'title': 'Next'}}])) AS h, generate_subscripts(list_concat(hs, [h2, h2, h2, h2]), 1) - 1 AS n FROM (SELECT *, {{'level': 0, 'title': ''}} AS h2 FROM own)
        ), flat AS (SELECT page_id, CAST(n AS INTEGER) AS n, h.level AS level, h.title AS title FROM rows)
        SELECT a.page_id, a.n, a.level, a.title, string_agg(b.title, ' > ' ORDER BY b.n) AS path
        FROM flat a JOIN flat b ON a.page_id = b.page_id AND b.n <= a.n AND (b.n = a.n OR b.level < a.level) AND NOT EXISTS (SELECT 1 FROM flat c WHERE c.page_id = a.page_id AND c.n > b.n AND c.n <= a.n AND c.level <= b.level)
        GROUP BY a.page_id, a.n, a.level, a.title""",
    "html_tables": "SELECT o_orderkey, 0 AS table_no, 0 AS row_no, 'Key|' AS cells FROM orders UNION ALL SELECT o_orderkey, 0, 1, o_orderkey || '|' || o_orderpriority || ' x' FROM orders UNION ALL SELECT o_orderkey, 1, 0, o_orderstatus FROM orders",
    "json_slice": """SELECT event_id, CASE WHEN event_id % 5 > 1 THEN '{"note": "a } in \\" text [", "rows": [1, {"p": ' || props || '}]}' END AS slice FROM events""",
    "tree_leaves": """WITH e AS (SELECT * FROM events WHERE event_id % 9 > 0)
        SELECT event_id, '$.type' AS path, event_type AS value FROM e UNION ALL SELECT event_id, '$.ids[0]', CAST(event_id AS VARCHAR) FROM e UNION ALL SELECT event_id, '$.ids[1][0]', CAST(user_id AS VARCHAR) FROM e
        UNION ALL SELECT event_id, '$.more.props.k', json_extract_string(props, '$.k') FROM e UNION ALL SELECT event_id, '$.more.none', NULL FROM e""",
    "candidate_dimensions": f"""WITH x AS (
          SELECT *, p_size % 6 + 1 AS tier, p_partkey % 11 = 0 AS mock, p_partkey % 4 AS pf, {_HAVE} AS have, 9 - ({_HAVE}) AS lack, {_WHY} AS why, substr(p_brand, 7, 2) AS ticker, ['Energy', 'Utilities', 'it', NULL][p_size % 4 + 1] AS sector, ['DE', 'F', NULL][p_partkey % 3 + 1] AS country, p_size % 5 AS ready FROM part
        ), y AS (SELECT *, array_to_string(why, ' ') AS reasons, concat_ws(' ', array_to_string(why, ' '), p_name, sector) AS t, concat_ws(' ', array_to_string(why, ' '), sector) AS g, CASE WHEN mock THEN 5 ELSE [95, 85, 70, 60, 40, 15][tier] END AS q, CAST(floor(round(have * 80 / 9.0::DOUBLE, 6)) AS INTEGER) AS share FROM x)
        SELECT p_partkey, CAST(CASE WHEN pf > 0 THEN least(95, q + least(45, pf * 15)) ELSE q END AS INTEGER) AS source_quality, CAST(floor(round((have + least(pf, lack)) * 100 / 9.0::DOUBLE, 6)) AS INTEGER) AS completeness, CAST(CASE WHEN len(why) = 0 THEN 10 ELSE {_theme('t', 10)} END AS INTEGER) AS theme,
          CAST(least(100, CASE WHEN length(ticker) >= 2 THEN 20 ELSE 0 END + CASE WHEN length(p_name) >= 3 THEN 20 ELSE 0 END + CASE WHEN length(sector) >= 3 THEN 45 ELSE 0 END + CASE WHEN length(country) >= 2 THEN 15 ELSE 0 END) AS INTEGER) AS business,
          CAST(CASE WHEN have = 0 THEN 5 WHEN tier = 6 THEN greatest(0, share - 20) WHEN tier = 5 THEN greatest(0, share - 10) ELSE least(100, share + 10) END AS INTEGER) AS financial, CAST([5, 30, 60, 85, 5][ready + 1] AS INTEGER) AS valuation,
          CAST(CASE WHEN len(why) = 0 THEN 10 ELSE least(CASE WHEN tier >= 5 THEN 50 ELSE 100 END, {_n('g', _GROWTH)} * 15 + 20) END AS INTEGER) AS growth, CAST(CASE WHEN len(why) = 0 THEN 10 ELSE least(100, {_n('reasons', [*_CATALYSTS, 'milestone'])} * 20 + 15) END AS INTEGER) AS catalyst,
          CAST(least(100, CASE WHEN mock THEN 40 WHEN tier = 5 THEN 20 WHEN tier = 6 THEN 35 ELSE 0 END + least(30, lack * 2) + least(20, p_partkey % 6 * 5)) AS INTEGER) AS risk FROM y""",
    "analysis_dimensions": f"""WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity > 40) AS large FROM lineitem GROUP BY 1
        ), x AS (SELECT orders.*, coalesce(n, 0) AS n, coalesce(returned, 0) AS returned, coalesce(large, 0) AS large FROM orders LEFT JOIN l USING (o_orderkey)
        ), y AS (SELECT *, o_orderkey % 5 AS q, o_orderstatus = 'P' AS mock, CASE WHEN o_orderkey % 6 > 1 THEN o_orderkey % 6 - 2 ELSE 0 END AS pf, CASE WHEN o_orderstatus = 'P' THEN 5 ELSE [90, 65, 30, 10, 10][o_orderkey % 5 + 1] END AS sq, least(returned, 5) AS bull, least(large, 5) AS tail, least(n, 5) AS head, array_to_string(list_slice({_LIST}, 1, least(returned, 5)), ' ') AS bt, array_to_string(list_slice(['await a trigger', 'sign the deal'], 1, o_orderkey % 3), ' ') AS nt, CAST(floor(round(n * 80 / nullif(n + returned, 0)::DOUBLE, 6)) AS INTEGER) AS base FROM x)
        SELECT o_orderkey, CAST(CASE WHEN pf > 0 THEN least(95, sq + least(45, pf * 15)) ELSE sq END AS INTEGER) AS source_quality, CAST(CASE WHEN n + returned = 0 THEN 0 ELSE floor(round((n + least(pf, returned)) * 100 / (n + returned)::DOUBLE, 6)) END AS INTEGER) AS completeness, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END + 30 AS INTEGER) AS business, CAST(CASE WHEN n + returned = 0 THEN 0 WHEN o_orderkey % 4 >= 2 THEN greatest(0, base - 15) ELSE base END AS INTEGER) AS financial,
          CAST(CASE WHEN bull = 0 THEN 15 ELSE {_theme("(bt || ' ' || o_orderpriority)", 15)} END AS INTEGER) AS theme, CAST(CASE WHEN bull = 0 AND tail = 0 THEN 10 ELSE greatest(5, least(100, bull * 12 + tail * 10 - head * 5 + 10)) END AS INTEGER) AS growth,
          CAST(CASE WHEN bull = 0 THEN 10 ELSE least(100, {_n("(bt || ' ' || nt)", _CATALYSTS)} * 20 + 10) END AS INTEGER) AS catalyst, CAST([5, 80, 30, 85][o_orderkey % 4 + 1] AS INTEGER) AS valuation,
          CAST(least(100, CASE WHEN mock THEN 40 ELSE 0 END + CASE WHEN q >= 2 THEN 25 ELSE 0 END + least(20, returned * 5) + least(15, large * 5)) AS INTEGER) AS risk FROM y""",
    "labelled_facts": f"WITH {FACTS}, {_PROSE} SELECT * FROM prose",
    "validated_facts": f"""WITH {FACTS}, {_PROSE}, c AS (
          SELECT entity, label, fy, v / 1000000 AS value, 'million' AS scale, 'html' AS method, 0 AS q, 0.9::DOUBLE AS confidence FROM (SELECT entity, fy, 'revenue' AS label, revenue AS v FROM facts UNION ALL SELECT entity, fy, 'gross', gross FROM facts) WHERE v IS NOT NULL AND fy % 3 > 0
          UNION ALL SELECT entity, label, fy, value, scale, 'native_pdf', 1, CASE WHEN label = 'gross' THEN 0.5 ELSE 0.7 END FROM prose WHERE kind = 'money'
          UNION ALL SELECT entity, 'revenue', fy, floor(revenue / 1000) * CASE WHEN fy % 5 = 0 THEN 10 ELSE 1 END, 'thousand', 'ocr', 2, 0.8 FROM facts WHERE fy % 2 = 0
        ), b AS (SELECT *, CASE scale WHEN 'thousand' THEN 1000 WHEN 'million' THEN 1000000 END * value AS whole FROM c
        ), pairs AS (SELECT a.entity, a.label, a.fy, bool_or(CASE WHEN a.scale IS NOT NULL AND z.scale IS NOT NULL THEN abs(a.whole - z.whole) > greatest(greatest(abs(a.whole), abs(z.whole)) * 0.01::DOUBLE, 0.5) ELSE abs(a.value - z.value) > greatest(greatest(abs(a.value), abs(z.value)) * 0.01::DOUBLE, 0.5) END) AS conflict
          FROM b a JOIN b z ON a.entity = z.entity AND a.label = z.label AND a.fy = z.fy GROUP BY ALL
        ), g AS (SELECT entity, label, fy, count(*) AS n, count(DISTINCT method) AS methods, bool_and(method = 'ocr') AS ocr, min_by(value, q) AS value, min_by(coalesce(scale, ''), q) AS scale, min_by(method, q) AS method, min_by(confidence, q) AS conf FROM b GROUP BY ALL
        ), d AS (SELECT *, round(CASE WHEN ocr THEN least(c1, 0.72) ELSE c1 END, 4) AS confidence FROM (SELECT *, CASE WHEN methods > 1 THEN least(conf + 0.1, 0.95) ELSE conf END AS c1 FROM g JOIN pairs USING (entity, label, fy))
        ), s AS (SELECT *, CASE WHEN conflict AND methods > 1 THEN 'rejected' WHEN conflict OR confidence < 0.6 OR entity % 6 = 0 THEN 'excerpt_only' ELSE 'validated' END AS validation FROM d)
        SELECT entity, label, fy, n, methods, validation, round(CASE WHEN NOT conflict THEN value END, 6) AS value, CASE WHEN NOT conflict THEN nullif(scale, '') END AS scale, method, CASE WHEN NOT conflict THEN confidence END AS confidence,
          CAST(row_number() OVER (PARTITION BY entity ORDER BY validation <> 'validated', label, fy) AS INTEGER) AS place FROM s""",
    "text_predicates": r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\bthe\b') AS word, contains(' ' || lower(coalesce(text, '')) || ' ', ' of the ') AS phrase, [1e6, 1e9, 1e3, 1e3, 1e12, 1e6, NULL][doc_id % 7 + 1] AS scale FROM documents""",
}
_TOTAL = "CAST(floor(round(source_quality * 0.2::DOUBLE + completeness * 0.18::DOUBLE + theme * 0.15::DOUBLE + business * 0.12::DOUBLE + financial * 0.12::DOUBLE + valuation * 0.1::DOUBLE + growth * 0.08::DOUBLE + catalyst * 0.05::DOUBLE, 6)) - floor(round(risk * 0.2::DOUBLE, 6)) AS INTEGER)"
SQL |= {
    "candidate_scorecard": f"""WITH dims AS ({SQL['candidate_dimensions']}), o AS (SELECT p_partkey, completeness, p_size % 6 + 1 AS tier, p_partkey % 11 = 0 AS mock, greatest(0, least(100, {_TOTAL})) AS raw FROM dims JOIN part USING (p_partkey)
        ), s AS (SELECT *, CAST(least(raw, CASE WHEN mock AND tier = 6 THEN 25 ELSE [100, 90, 80, 75, 60, 30][tier] END) AS INTEGER) AS overall_score FROM o)
        SELECT p_partkey, overall_score, CASE WHEN mock THEN 'not_enough_data' WHEN tier >= 5 THEN CASE WHEN overall_score >= 50 THEN 'needs_primary_sources' ELSE 'not_enough_data' END WHEN overall_score < 20 OR completeness < 20 THEN 'not_enough_data' WHEN overall_score < 35 THEN 'low_priority_research'
          WHEN overall_score < 55 THEN 'needs_primary_sources' WHEN overall_score < 70 THEN 'ready_for_deeper_analysis' ELSE 'high_priority_for_human_review' END AS status FROM s""",
    "council_scorecard": f"""WITH dims AS ({SQL['analysis_dimensions']}), r AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'R') AS gaps FROM lineitem GROUP BY 1
        ), o AS (SELECT o_orderkey, o_orderstatus = 'P' AS mock, o_orderkey % 4 AS t, o_orderkey % 3 AS c, o_orderkey % 5 AS q, coalesce(gaps, 0) AS gaps, greatest(0, least(100, {_TOTAL})) AS raw FROM dims JOIN orders USING (o_orderkey) LEFT JOIN r USING (o_orderkey)
        ), s AS (SELECT *, CAST(least(raw, CASE WHEN mock AND t = 3 THEN 25 ELSE [100, 80, 60, 30][t + 1] END) AS INTEGER) AS overall_score FROM o)
        SELECT o_orderkey, overall_score, CASE WHEN mock THEN 'not_enough_data' WHEN c = 0 OR q >= 3 THEN 'reject_due_to_data_quality' WHEN t >= 2 THEN 'needs_primary_sources' WHEN gaps > 5 THEN 'low_priority_research' WHEN overall_score >= 70 AND q < 2 THEN 'high_priority_for_human_review'
          WHEN overall_score >= 55 THEN 'ready_for_deeper_analysis' WHEN overall_score >= 35 THEN 'needs_primary_sources' WHEN overall_score >= 20 THEN 'low_priority_research' ELSE 'not_enough_data' END AS status FROM s""",
    "vendor_fundamentals": """WITH c AS (SELECT c_custkey, c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE) AS bal FROM customer WHERE c_custkey % 10 <> 9
        ), y AS (SELECT *, 'income_statement.' || y || '-12-31' AS p, y FROM c, (SELECT unnest([2023, 2024]) AS y))
        SELECT c_custkey, 'general.gic_sector' AS field_name, c_mktsegment AS text, CAST(NULL AS DOUBLE) AS value, NULL AS unit FROM c WHERE c_mktsegment <> ''
        UNION ALL SELECT c_custkey, 'highlights.market_cap_mln', NULL, CASE c_custkey % 3 WHEN 1 THEN c_custkey * 2 ELSE c_custkey END, 'USD_m' FROM c WHERE c_custkey % 3 > 0
        UNION ALL SELECT c_custkey, 'highlights.pe_ratio', NULL, 12.5, 'x' FROM c
        UNION ALL SELECT c_custkey, 'shares.float_mln', NULL, round(c_custkey * 10000 / 1e6, 4), 'M shares' FROM c
        UNION ALL SELECT c_custkey, 'technicals.52_week_high', NULL, bal, NULL FROM c
        UNION ALL SELECT c_custkey, p || '.total_revenue_mln', NULL, round((c_custkey * 1000000 + y) / 1e6, 4), 'USD_m' FROM y
        UNION ALL SELECT c_custkey, p || '.eps', NULL, bal, 'USD' FROM y
        UNION ALL SELECT c_custkey, 'balance_sheet.2022.total_assets_mln', NULL, c_custkey * 3, 'USD_m' FROM c""",
}
