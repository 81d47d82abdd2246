"""SQL of the queries on market texts: every phrase looked for in every text, one by one."""

from tessera.functions import market as V
from tessera.plans.market_queries import ADDED, CLAIMS, FORMS, HEADLINES, ITEMS, THESES

_q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
_any = lambda ps: f"len(list_filter({_list(ps)}, lambda p: contains(t, p))) > 0"
_case = lambda c, table, other="NULL": f"CASE {c} " + " ".join(f"WHEN {_q(k) if isinstance(k, str) else k} THEN {_q(v)}" for k, v in table.items()) + f" ELSE {other} END"
_rows = lambda table: ", ".join(f"({i}, {_q(v)}, {_q(p)})" for i, (v, ps) in enumerate(table.items()) for p in ps)
_said = lambda use: f"(SELECT doc_id, list(v ORDER BY i) AS vs FROM (SELECT DISTINCT doc_id, i, v FROM d JOIN {use} ON contains(t, ' ' || p || ' ')) GROUP BY 1)"
_REGION = {c: r for c, (r, _) in V.COUNTRIES.items()}

# Nothing looks ahead in these patterns: a number takes along what follows it, and is none where that goes on as a word.
_WHOLE = r"(?:\d[\d.,]*\d|\d)"
_NUMBER = rf"{_WHOLE}[\t\n\x0b\f\r ]*(?:%|billion|bn|million|mn|m|thousand|k)[^\p{{L}}\d]|{_WHOLE}\p{{L}}|{_WHOLE}"
_NUMBERS = rf"list_filter(regexp_extract_all(low || ' ', '{_NUMBER}'), lambda m: NOT regexp_matches(m, '\p{{L}}$'))"
_UNIT = "regexp_extract(m, '%|[a-z]+')"
_DIGITS = "regexp_extract(m, '^[0-9.,]+')"
_VALUE = f"""TRY_CAST(CASE WHEN contains({_DIGITS}, ',') AND contains({_DIGITS}, '.') THEN CASE WHEN length({_DIGITS}) - strpos(reverse({_DIGITS}), ',') > length({_DIGITS}) - strpos(reverse({_DIGITS}), '.') THEN replace(replace({_DIGITS}, '.', ''), ',', '.') ELSE replace({_DIGITS}, ',', '') END
    WHEN contains({_DIGITS}, ',') THEN CASE WHEN regexp_full_match({_DIGITS}, '\\d{{1,3}},\\d{{3}}') OR length({_DIGITS}) - length(replace({_DIGITS}, ',', '')) > 1 THEN replace({_DIGITS}, ',', '') ELSE replace({_DIGITS}, ',', '.') END
    WHEN length({_DIGITS}) - length(replace({_DIGITS}, '.', '')) > 1 THEN replace({_DIGITS}, '.', '') ELSE {_DIGITS} END AS DOUBLE)
    * CASE WHEN {_UNIT} IN ('billion', 'bn') THEN 1e9 WHEN {_UNIT} IN ('million', 'mn', 'm') THEN 1e6 WHEN {_UNIT} IN ('thousand', 'k') THEN 1e3 ELSE 1 END"""
_PERCENT = f"{_UNIT} = '%'"
_LOWER = lambda t: f"lower(replace({t}, 'İ', 'i\u0307'))"
_PEERS = r"(^|[^\p{L}\p{N}_])peer[\t\n\x0b\f\r -]groups?([^\p{L}\p{N}_]|$)"
_MACRO = "macroeconomic|macro-economic|currency headwind|fx headwind|inflation|geopolitical|consumer demand headwind|interest rate headwind"
_SEGMENTS = "segment|by business|by division|by region|business area|business group|business unit"


def _of_theme(i: int) -> str:
    whens = " ".join(f"WHEN {_q(t)} THEN {_list(spec[i])}" for t, spec in V.THEMES.items())
    flat = f"flatten(list_transform(coalesce(th.vs, []), lambda x: CASE x {whens} END))"
    return f"array_to_string(list_filter({flat}, lambda x, n: list_position({flat}, x) = n), ',')"


SQL = {
    "market_theses": rf"""WITH d AS (SELECT doc_id, ' ' || trim(lower(regexp_replace(concat_ws(' ' || chr(9), {_list(THESES)}[doc_id % {len(THESES)} + 1], text), '[\t\n\x0b\f\r ]+', ' ', 'g'))) || ' ' AS t FROM documents
        ), themes(i, v, p) AS (VALUES {_rows({t: s[0] for t, s in V.THEMES.items()})}), countries(i, v, p) AS (VALUES {_rows({c: ps for c, (_, ps) in V.COUNTRIES.items()})}), regions(i, v, p) AS (VALUES {_rows(V.REGIONS)}), sizes(i, v, p) AS (VALUES {_rows(V.SIZES)}), intents(i, v, p) AS (VALUES {_rows(V.INTENTS)}
        ), k AS (SELECT doc_id, string_agg(p, ',' ORDER BY p) AS ps FROM (SELECT DISTINCT doc_id, p FROM d JOIN themes ON contains(t, ' ' || p || ' ')) GROUP BY 1
        ), x AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, '(?:^|[^a-z0-9])(?:{"|".join(V.EXCLUSIONS)})[^a-z0-9]+([a-z0-9]+)', 1))) AS ex FROM d
        ), j AS (
          SELECT d.doc_id, th.vs IS NOT NULL OR co.vs IS NOT NULL OR re.vs IS NOT NULL OR si.vs IS NOT NULL OR it.vs IS NOT NULL AS said, th.vs AS tv, co.vs AS cv, re.vs AS rv, si.vs AS sv, it.vs AS iv, k.ps, ex, {_of_theme(1)} AS sectors, {_of_theme(2)} AS industries,
            list_concat(coalesce(re.vs, []), list_transform(coalesce(co.vs, []), lambda c: {_case('c', _REGION)})) AS rs
          FROM d LEFT JOIN {_said('themes')} th USING (doc_id) LEFT JOIN {_said('countries')} co USING (doc_id) LEFT JOIN {_said('regions')} re USING (doc_id) LEFT JOIN {_said('sizes')} si USING (doc_id) LEFT JOIN {_said('intents')} it USING (doc_id) LEFT JOIN k USING (doc_id) JOIN x USING (doc_id))
        SELECT doc_id, CASE WHEN said THEN coalesce(array_to_string(tv, ','), '') END AS themes, CASE WHEN said THEN coalesce(ps, '') END AS keywords, CASE WHEN said THEN sectors END AS sectors, CASE WHEN said THEN industries END AS industries,
          CASE WHEN said THEN array_to_string(list_filter(rs, lambda r, n: list_position(rs, r) = n), ',') END AS regions, CASE WHEN said THEN coalesce(array_to_string(cv, ','), '') END AS countries, CASE WHEN said THEN coalesce(array_to_string(sv, ','), '') END AS sizes,
          CASE WHEN said THEN coalesce(array_to_string(iv, ','), '') END AS intents, tv[1] AS theme, cv[1] AS country, coalesce({_case('cv[1]', _REGION)}, rv[1]) AS region, coalesce(list_contains(iv, 'vague'), false) AS vague, CASE WHEN len(ex) > 0 THEN array_to_string(ex, ',') END AS excluded
        FROM j WHERE said OR len(ex) > 0""",
    "market_catalysts": f"""WITH d AS (
          SELECT doc_id, lower({_list(HEADLINES)}[doc_id % {len(HEADLINES)} + 1] || ' ' || coalesce(text, '')) AS t, doc_id % 6 + 1 AS tier, {_list(FORMS)}[doc_id % 5 + 1] AS form, string_split({_list(ITEMS)}[(doc_id // 5) % 5 + 1], ',') AS items, doc_id % 11 = 0 AS filing, doc_id % 13 = 0 AS multi, coalesce(length(text) > 20, false) AS detail FROM documents
        ), w AS (SELECT *, {_any(V.NEGATIVE)} AS neg, {_any(V.POSITIVE)} AS pos, {_any(V.PRAISE + V.MARKETING)} AS low, {_any(V.SCHEDULES)} AS sched, CASE {" ".join(f"WHEN {_any(ps)} THEN {_q(c)}" for c, ps in V.CATEGORIES.items())} ELSE 'other' END AS word FROM d
        ), m AS (SELECT *, list_filter(items, lambda i: {_case('i', {k: c for k, (c, _) in V.ITEMS.items()})} IS NOT NULL) AS known FROM w
        ), i AS (SELECT *, coalesce(list_filter(known, lambda i: {_case('i', {k: d for k, (_, d) in V.ITEMS.items()})} = 'negative')[1], known[1]) AS item, {_case('upper(form)', V.FORMS)} AS fc FROM m
        ), g AS (SELECT *, {_case('item', {k: c for k, (c, _) in V.ITEMS.items()})} AS ic, {_case('item', {k: d for k, (_, d) in V.ITEMS.items()})} AS idir, CASE WHEN neg AND pos THEN 'mixed' WHEN neg THEN 'negative' WHEN pos THEN 'positive' WHEN word = 'other' THEN 'unknown' ELSE 'neutral' END AS wd, CASE WHEN neg AND NOT pos AND word IN ('other', 'operations') THEN 'risk_event' ELSE word END AS wc FROM i
        ), c AS (SELECT *, coalesce(ic, fc, wc) AS category, CASE WHEN ic IS NOT NULL THEN 'items' WHEN fc IS NOT NULL THEN 'form' ELSE 'words' END AS basis, coalesce(idir, CASE WHEN fc IS NOT NULL THEN 'neutral' END) AS given, CASE WHEN multi THEN 'multi_source_confirmed' ELSE {_case('tier', V.EVIDENCE, "'model_inferred'")} END AS evidence FROM g
        ), e AS (SELECT *, CASE WHEN given IS NULL OR (given IN ('neutral', 'unknown') AND wd IN ('negative', 'positive', 'mixed')) THEN wd ELSE given END AS direction, evidence IN ('regulator_confirmed', 'primary_confirmed', 'multi_source_confirmed') AS prime FROM c
        ), s AS (SELECT *, CASE WHEN low THEN 'low_signal' WHEN sched THEN 'contextual' WHEN filing OR list_contains({_list(V.DECISIVE)}, category) THEN 'decision_relevant' ELSE 'contextual' END AS materiality,
            CASE WHEN prime AND list_contains({_list(V.MATERIAL)}, category) AND direction <> 'unknown' THEN 'high' WHEN prime OR evidence = 'single_source_reported' THEN 'medium' WHEN evidence = 'aggregator_only' AND detail THEN 'low' ELSE 'unknown' END AS st FROM e
        ), f AS (SELECT *, CASE WHEN st = 'high' AND materiality = 'low_signal' THEN 'low' ELSE st END AS strength FROM s)
        SELECT doc_id, category, direction, strength, evidence, materiality, round(greatest(0, least(1, CAST({" ".join(["CASE evidence"] + [f"WHEN {_q(k)} THEN {v}" for k, v in V.SURENESS.items()] + ["END"])} AS DOUBLE) + CASE strength WHEN 'high' THEN 0.1::DOUBLE WHEN 'unknown' THEN -0.1::DOUBLE ELSE 0 END - CASE WHEN direction = 'unknown' THEN 0.1::DOUBLE ELSE 0 END)), 2) AS confidence, basis FROM f""",
    "market_news": f"""WITH d AS (SELECT doc_id, {_list(ADDED)}[doc_id % {len(ADDED)} + 1] AS added, lower(coalesce(text, '')) AS body, doc_id % 6 + 1 AS tier, CASE WHEN doc_id % 4 > 0 THEN doc_id % 200 <= 90 END AS recent, doc_id % 11 % 3 AS host, doc_id % 9 + 2 AS k, doc_id % 7 AS r FROM documents
        ), t AS (SELECT *, lower(replace(replace(replace(added, '{{name}}', 'quorv' || translate(CAST(k AS VARCHAR), '0123456789', 'bcdfghjklm')), '{{ticker}}', 'qx' || translate(CAST(k AS VARCHAR), '0123456789', 'bcdfghjklm')), '{{TICKER}}', 'qx' || translate(CAST(k AS VARCHAR), '0123456789', 'bcdfghjklm'))) || ' ' || body AS t FROM d
        ), c AS (SELECT *, {_any(V.FINANCE)} AS finance, {_any(V.KITCHEN)} AS kitchen, {_any(V.CATALYSTS)} AS catalyst, regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(solar|wind)([^\\p{{L}}\\p{{N}}_]|$)') AS energy, regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])shoppers([^\\p{{L}}\\p{{N}}_]|$)') AS retail FROM t
        ), p AS (SELECT *, k AS s_suppkey, r IN (1, 2) AS ticker, r IN (0, 2) AS named, false AS ambiguous FROM c WHERE r <= 2 UNION ALL SELECT *, 1, false, true, true FROM c WHERE r IN (3, 4)
        ), s AS (SELECT *, host = 2 AS poor, named AND kitchen AND NOT ticker AND NOT finance AS cooked, CASE WHEN s_suppkey % 2 = 1 THEN 'energy' ELSE 'retail' END AS sector FROM p JOIN supplier USING (s_suppkey)
        ), f AS (SELECT *, CASE WHEN poor THEN 0.05::DOUBLE WHEN cooked THEN 0.0::DOUBLE ELSE round(greatest(0, least(1, round(CASE WHEN ticker THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN named AND ambiguous THEN 0.25::DOUBLE WHEN named THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN tier <= 2 THEN 0.15::DOUBLE WHEN tier <= 4 THEN 0.1::DOUBLE ELSE 0 END
              + CASE recent WHEN true THEN 0.1::DOUBLE WHEN false THEN -0.1::DOUBLE ELSE 0 END + CASE WHEN catalyst THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN host = 1 THEN 0.1::DOUBLE ELSE 0 END, 6))), 2) END AS base, NOT poor AND NOT cooked AND (ticker OR (named AND (NOT ambiguous OR finance))) AS specific FROM s
        ), g AS (SELECT *, NOT specific AND NOT (poor OR cooked) AND CASE sector WHEN 'energy' THEN energy ELSE retail END AS context FROM f), h AS (SELECT *, CASE WHEN context THEN greatest(base, 0.45::DOUBLE) ELSE base END AS score FROM g)
        SELECT doc_id, s_suppkey, sector, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'irrelevant' END AS level, specific, CASE WHEN ticker AND named THEN 'ticker,name' WHEN ticker THEN 'ticker' ELSE 'name' END AS named_by, poor OR cooked AS filtered, context AS is_industry_context FROM h""",
    "page_documents": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^http:', 'https:') AS u, page_id % 5 AS k FROM pages
        ), o AS (SELECT *, regexp_extract(u, '^https://[^/?#]+') AS origin, regexp_extract(u, '^https://[^/?#]+(?:[^?#]*/)?') AS folder FROM p
        ), l AS (
          SELECT page_id, origin || '/files/annual-report-' || page_id || '.pdf?v=1' AS url, 'Annual report' AS title, 'annual_report' AS kind, 'anchors' AS strategy, 0 AS s, 0 AS n FROM o WHERE k = 0
          UNION ALL SELECT page_id, origin || '/news/' || page_id || '.pdf', 'Press release ' || page_id, 'results_release', 'json_ld', 1, 0 FROM o WHERE k = 1
          UNION ALL SELECT page_id, origin || '/i-' || page_id || '.pdf', 'Interim report', 'interim_report', 'hydration', 2, 0 FROM o WHERE k = 2
          UNION ALL SELECT page_id, CASE WHEN ends_with(folder, '/') THEN folder ELSE folder || '/' END || 'deck-' || page_id || '.pdf', 'Webcast deck', 'presentation', 'hydration', 2, 0 FROM o WHERE k = 3
          UNION ALL SELECT page_id, origin || '/e-' || page_id || '.pdf', 'e ' || page_id, 'other', 'embedded_json', 3, 1 FROM o WHERE k = 3
          UNION ALL SELECT page_id, origin || '/g-' || page_id || '.pdf', 'g ' || page_id, 'other', 'embedded_json', 3, 0 FROM o WHERE k = 4
          UNION ALL SELECT page_id, origin || '/fy-' || page_id || '.pdf', 'Full-year results', 'annual_report', 'feed', 4, 0 FROM o WHERE page_id % 4 = 0)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY list_position(['annual_report', 'results_release', 'interim_report', 'presentation', 'other'], kind), s, n) AS INTEGER) AS place, url, title, kind, strategy, true AS is_document FROM l""",
    "claim_grounding": rf"""WITH c AS (
          SELECT conv_id || ':' || turn AS claim, conv_id % 2 AS run, {_LOWER(f"coalesce(text, '') || ' ' || replace({_list(CLAIMS)}[(conv_id + turn) % {len(CLAIMS)} + 1], '{{x}}', CAST(conv_id % 97 + 10 AS VARCHAR))")} AS low, list_distinct([conv_id % 97, conv_id % 89, -1]) AS cited FROM conversations WHERE role = 'assistant'
        ), e AS (SELECT doc_id AS id, {_LOWER("concat_ws(' ', text, 'It was', CAST(doc_id + 10 AS VARCHAR), 'million.', CASE WHEN doc_id % 5 = 0 THEN 'Inflation.' END)")} AS low, CASE doc_id % 4 WHEN 0 THEN 'group' WHEN 1 THEN 'Watches' END AS scope, CASE doc_id % 3 WHEN 0 THEN '2024' WHEN 1 THEN '2023' END AS period FROM documents WHERE doc_id < 97
        ), cn AS (SELECT claim, unnest(range(len(ms))) AS n, unnest(ms) AS m FROM (SELECT claim, {_NUMBERS} AS ms FROM c)), en AS (SELECT id, unnest({_NUMBERS}) AS m FROM e
        ), cv AS (SELECT * FROM (SELECT claim, n, {_VALUE} AS v, {_PERCENT} AS pc FROM cn) WHERE isfinite(v)), ev AS (SELECT DISTINCT * FROM (SELECT id, {_VALUE} AS v, {_PERCENT} AS pc FROM en) WHERE isfinite(v)
        ), cites AS (SELECT claim, unnest(cited) AS id FROM c
        ), g AS (SELECT claim, count(DISTINCT n) AS grounded FROM cv JOIN cites USING (claim) JOIN ev USING (id, pc) WHERE abs(cv.v - ev.v) <= greatest(cv.v, ev.v) * 0.01::DOUBLE GROUP BY 1
        ), j AS (SELECT claim, count(e.id) AS valid, count(*) FILTER (e.id IS NULL) AS invalid, count(DISTINCT scope) AS scopes, count(DISTINCT period) AS periods, count(*) FILTER (scope <> 'group') AS segments, coalesce(bool_or(regexp_matches(e.low, '{_MACRO}')), false) AS said FROM cites LEFT JOIN e USING (id) GROUP BY 1
        ), n AS (SELECT claim, count(*) AS n FROM cv GROUP BY 1)
        SELECT claim, valid, invalid, CAST(coalesce(n.n, 0) AS INTEGER) AS numbers, coalesce(grounded, 0) AS grounded, coalesce(n.n, 0) >= 2 AND (scopes > 1 OR periods > 1) AS mixed,
          valid > 0 AND scopes = 0 AND ((regexp_matches(regexp_replace(regexp_replace(low, '{_PEERS}', '\1 \2', 'g'), '{_PEERS}', '\1 \2', 'g'), 'consolidated|group') AND NOT regexp_matches(low, '{_SEGMENTS}')) OR (run = 0 AND regexp_matches(low, '(^|[^\p{{L}}\p{{N}}])watches([^\p{{L}}\p{{N}}]|$)'))) AS unscoped,
          regexp_matches(low, '{_MACRO}') AND valid > 0 AND segments = valid AND NOT said AS macro
        FROM c JOIN j USING (claim) LEFT JOIN g USING (claim) LEFT JOIN n USING (claim)""",
    "submission_profiles": """WITH c AS (SELECT *, CASE WHEN c_custkey > 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik, c_custkey % 5 AS e FROM customer WHERE c_custkey % 7 <> 6)
        SELECT c_custkey, cik, c_name AS legal_name, CASE WHEN c_custkey % 3 > 0 THEN 'T' || c_custkey ELSE cik END AS ticker, CASE WHEN c_custkey % 2 = 0 THEN 'NYSE' END AS exchange, nullif(c_mktsegment, '') AS industry, CASE e WHEN 0 THEN 'December' WHEN 1 THEN 'June' WHEN 2 THEN '1331' END AS fiscal_year_end,
          CAST(NULL AS VARCHAR) AS website, 'SIC: ' || c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '. Incorporated in: Delaware' END AS description, CASE WHEN c_custkey % 3 > 0 THEN 2 ELSE 0 END AS n_tickers FROM c""",
    "evidence_channels": """WITH d AS (SELECT *, doc_id % 5 = 0 AS fact, doc_id % 5 = 1 AS meta FROM documents LEFT JOIN labels USING (doc_id)
        ), e AS (SELECT source, count(*) FILTER (doc_id % 2 = 0) AS refs, count(*) FILTER (NOT fact AND NOT meta AND doc_id % 3 > 0 AND trim(coalesce(text, '')) <> '') AS extracted, count(*) FILTER (fact) AS facts, count(*) FILTER (quality = 1) AS de, count(*) FILTER (quality = 0) AS dm,
            count(*) FILTER (quality IS NULL AND doc_id % 9 = 0) AS df FROM d GROUP BY 1
        ), t AS (SELECT *, 'src' || conv_id % 20 AS source FROM conversations), c AS (SELECT source, count(DISTINCT conv_id % 11) AS ids, count(*) AS n FROM t WHERE role <> 'assistant' GROUP BY 1
        ), k AS (SELECT source, count(DISTINCT sha1(coalesce(text, ''))) AS hs, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY 1
        ), x AS (SELECT source, coalesce(refs, 0) AS refs, coalesce(extracted, 0) AS extracted, coalesce(facts, 0) AS facts, coalesce(ids, 0) + coalesce(hs, 0) AS sources, coalesce(c.n, 0) + coalesce(k.n, 0) AS cites, coalesce(k.n, 0) AS links, coalesce(de, 0) AS de, dm, coalesce(df, 0) AS df FROM e FULL JOIN c USING (source) FULL JOIN k USING (source)
        ), n AS (SELECT *, unnest(['issuer_documents', 'regulator_facts', 'regulator_filings', 'issuer_newsroom', 'stored_citations']) AS channel, unnest([de, facts, df, 0, cites + links]) AS n FROM x)
        SELECT source, channel, n > 0 AS available, CAST(n AS BIGINT) AS n, refs AS "references", extracted, facts, sources, cites AS citations, links, dm AS documents_metadata_only FROM n""",
    "search_plans": """WITH p AS (SELECT p_partkey, 'T' || p_partkey AS t, CASE WHEN p_partkey % 5 > 0 AND p_name <> '' THEN p_name ELSE 'T' || p_partkey END AS c, CASE WHEN p_partkey % 3 > 0 THEN nullif(p_brand, '') END AS s, CASE WHEN p_partkey % 2 = 0 THEN nullif(p_type, '') END AS i FROM part
        ), q AS (
          SELECT p_partkey, unnest(['company', 'company', 'primary_source', 'primary_source', 'primary_source', 'industry', 'industry', 'industry', 'industry', 'exchange', 'exchange', 'exchange', 'regulatory', 'regulatory', 'regulatory']) AS kind, unnest(range(15)) AS o,
            unnest(['"' || c || '" ' || t || ' latest news', '"' || c || '" earnings guidance product regulatory management', '"' || c || '" investor relations', '"' || c || '" newsroom press release', t || ' press release',
              '"' || s || '" sector recent news', '"' || i || '" industry recent news', CASE WHEN s IS NOT NULL THEN '"' || i || '" supply chain regulation trends' END, CASE WHEN s IS NULL AND i IS NULL THEN t || ' industry peers recent news' END,
              c || ' exchange announcement', t || ' regulatory news', '{TICKER}', c || ' 10-K', trim(c || ' annual report ' || coalesce(i, '')), t || ' 8-K']) AS query FROM p
        ), n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, kind ORDER BY o) - 1 AS n FROM q WHERE query IS NOT NULL
        ), cut AS (SELECT * FROM n WHERE n < CASE kind WHEN 'company' THEN 3 WHEN 'regulatory' THEN 10 WHEN 'exchange' THEN 2 ELSE 3 END
        ), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY list_position(['company', 'primary_source', 'industry', 'exchange', 'regulatory'], kind), n) AS place FROM cut)
        SELECT p_partkey, kind, CAST(n AS INTEGER) AS n, query FROM r WHERE place <= 10""",
}
