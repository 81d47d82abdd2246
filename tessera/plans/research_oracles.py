"""SQL for research_queries."""

from tessera.plans.oracles import _CLASSES, FACTS, FEED, PRICES, TREND, _hits, _relevance

_D = "docs AS (SELECT doc_id, source, lower(coalesce(text, '')) AS t FROM documents)"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_RELEVANCE = _relevance("text")

SQL = {
    "price_csv_scan": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, 1.5::DOUBLE AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low, o_totalprice AS close, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS volume
        FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 11 > 0""",
    "price_json_scan": f"WITH {PRICES} SELECT instrument, date, CAST(volume AS DOUBLE) AS close, volume FROM prices WHERE volume % 9 > 0 AND volume % 7 > 0",
    "concept_facts_scan": f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fy DESC) AS n FROM facts WHERE fy % 3 > 0)
        SELECT entity, 'revenue' AS item, CASE WHEN entity % 2 = 0 THEN 'SalesNet' ELSE 'Revenues' END AS concept, 'USD' AS unit, fy, round(revenue / 1000000, 2) AS value_mln FROM r WHERE n = 1
        UNION ALL SELECT entity, 'gross', 'GrossProfit', 'USD', fy, round(gross / 1000000, 2) FROM r WHERE n = 1 AND gross IS NOT NULL""",
    "filings_scan": """WITH f AS (SELECT o_custkey, o_orderkey AS accession, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '8-K' WHEN '4-NOT SPECIFIED' THEN 'S-1' ELSE '4' END AS form, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderdate AS DATE) END AS day, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS n FROM orders),
        k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC NULLS LAST, list_position(['10-K', '10-Q', '8-K'], form), n) AS place FROM f WHERE form IN ('10-K', '10-Q', '8-K') AND coalesce(date_diff('day', day, DATE '2001-12-31') <= 1500, TRUE))
        SELECT o_custkey, n, accession, form, coalesce(strftime(day, '%Y-%m-%d'), 'unknown') AS filing_date, day, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4""",
    "item_codes": """SELECT o_orderkey, (o_custkey % 9 + 1) || '.0' || (o_orderkey % 5) || '|9.01' AS codes, CASE WHEN o_custkey >= 1 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS cik,
        substr(a, 1, 10) || '-' || substr(a, 11, 2) || '-' || substr(a, 13, 6) AS accession, concat_ws('/', 'data', CASE WHEN o_custkey >= 1 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END, a) AS path FROM (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS a FROM orders)""",
    "feed_scan": "SELECT page_id, 0 AS n, 't' || page_id AS title, url AS link FROM pages",
    "primary_document_choice": """WITH e AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'EX-99' WHEN l_returnflag = 'R' AND l_quantity > 40 THEN '10-K' ELSE 'GRAPHIC' END AS kind, 'd' || l_partkey || '-' || l_suppkey || CASE WHEN l_linestatus = 'O' THEN '.htm' ELSE '.txt' END AS name, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_linenumber = 7 AND l_tax = 0 AS hint FROM lineitem),
        r AS (SELECT *, CASE WHEN hint THEN 0 WHEN kind = '10-K' THEN 1 WHEN kind NOT LIKE 'EX%' AND name LIKE '%.htm' THEN 2 WHEN kind NOT LIKE 'EX%' THEN 3 END AS rule FROM e)
        SELECT l_orderkey, rule, name, size FROM r WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY rule, CASE WHEN rule = 2 THEN -size END NULLS FIRST, name) = 1""",
    "synthetic_prices": "SELECT p_partkey, day, round(round(p_retailprice * pow(1 + 0.08::DOUBLE / 365, day), 4), 2) AS price FROM part, (SELECT unnest([0, 30, 365]) AS day)",
    "provider_fallback": """WITH v AS (SELECT l_suppkey, max(l_extendedprice) FILTER (l_quantity >= 50) AS a, max(l_extendedprice) FILTER (l_quantity < 50) AS b FROM lineitem GROUP BY 1), w AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 > 2 THEN a END AS a, CASE WHEN s_suppkey % 10 > 0 THEN b END AS b FROM supplier LEFT JOIN v ON s_suppkey = l_suppkey)
        SELECT s_suppkey, coalesce(a, b) AS v, CASE WHEN a IS NOT NULL THEN '' WHEN b IS NOT NULL THEN 'fallback used' ELSE 'not sourced' END AS warning FROM w""",
    "bounded_envelope": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS text FROM documents WHERE text IS NOT NULL), i AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 6))) AS items FROM d)
        SELECT doc_id, md5('{"text":"' || substr(text, 1, 200) || '","items":[' || array_to_string(list_transform(items[:5], lambda t: '"' || t || '"'), ',') || '],"omitted":' || greatest(len(items) - 5, 0) || '}') AS envelope_md5 FROM i""",
    "ticker_index": "SELECT 'T' || s_suppkey AS ticker, CASE WHEN s_suppkey >= 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik, s_name AS title FROM supplier WHERE s_nationkey < 20",
    "thesis_relevance": """WITH w AS (SELECT *, len(list_distinct(list_intersect(string_split(p_name, ' '), ['small', 'red', 'ring', 'widget']))) AS words FROM part)
        SELECT p_partkey, round(round(greatest(0.0::DOUBLE, least(100.0, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 45 ELSE 0 END + least(words * 5, 15) + CASE WHEN p_type = 'ECONOMY' THEN 10 ELSE 0 END + CASE WHEN p_size > 25 THEN 10 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 12 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 4 ELSE 0 END + (p_size % 10) / 10 * 4.0::DOUBLE - CASE WHEN p_partkey % 7 = 0 THEN 15 ELSE 0 END)), 6), 1) AS relevance FROM w""",
    "news_relevance": f"""WITH {_D}, s AS (SELECT doc_id, CASE WHEN contains(t, 'worthless') THEN 0.0::DOUBLE ELSE round(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN contains(t, 'thereness') OR contains(t, ' les ') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN contains(t, ' the ') THEN 0.4::DOUBLE WHEN contains(t, ' und ') THEN 0.25::DOUBLE ELSE 0 END
          + CASE doc_id % 3 + 1 WHEN 1 THEN 0.15::DOUBLE WHEN 2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN doc_id % 40 >= 30 THEN 0 WHEN doc_id % 40 <= 14 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END + CASE WHEN contains(t, 'tion') THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN source = 'src1' THEN 0.1::DOUBLE ELSE 0 END)), 6), 2) END AS score FROM docs)
        SELECT doc_id, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'irrelevant' END AS level FROM s""",
    "evidence_categories": """WITH k AS (
          SELECT role, CASE WHEN role = 'system' THEN 'metadata_only' ELSE '' END AS quality, conv_id % 6 + 1 AS tier, turn % 7 = 0 AS ratio, turn % 5 = 0 AS catalyst,
                 coalesce(['sec_financial_statement', 'company_filing', 'company_ir_financial_fact', 'derived_financial_metric', 'market_metric', 'financial_data_summary', 'company_ir_statement_excerpt', 'company_ir_annual_report_text', 'own_excerpt', 'catalyst_event', 'market_news', 'press_release', 'website', NULL][length(coalesce(text, '')) % 14 + 1], '') AS st
          FROM conversations)
        SELECT role, CASE WHEN quality = 'metadata_only' THEN 'source_reference' WHEN st IN ('sec_financial_statement', 'company_filing', 'company_ir_financial_fact') THEN 'financial_fact' WHEN st IN ('derived_financial_metric', 'market_metric') OR ratio THEN 'price_trend_metric'
            WHEN st = 'financial_data_summary' THEN 'financial_summary' WHEN st = 'company_ir_statement_excerpt' THEN 'statement_table_content' WHEN st LIKE '%excerpt%' OR st LIKE '%annual_report%' THEN 'primary_document'
            WHEN catalyst OR st LIKE '%event%' OR st LIKE '%news%' THEN CASE WHEN tier = 1 OR st LIKE '%press%' THEN 'company_press' WHEN tier <= 2 THEN 'regulator_event' WHEN tier IN (3, 4) THEN 'material_news' ELSE 'low_tier_news' END
            WHEN st LIKE '%press%' THEN 'company_press' ELSE 'source_reference' END AS category, count(*) AS n
        FROM k GROUP BY 1, 2""",
    "catalyst_classify": """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'results' WHEN doc_id % 7 = 0 THEN 'management' WHEN doc_id % 4 = 0 THEN 'annual_report' WHEN doc_id % 9 = 0 THEN 'interim_report' WHEN regexp_matches(t, 'order|contract') THEN 'contract' WHEN regexp_matches(t, 'result|revenue') THEN 'results' WHEN regexp_matches(t, 'the|and') THEN 'general' ELSE 'other' END AS category,
               CASE WHEN regexp_matches(t, 'worthless|threat|loss') THEN 'negative' WHEN regexp_matches(t, 'growth|rising|gain') THEN 'positive' ELSE 'neutral' END AS direction FROM d""",
    "section_gaps": "WITH f AS (SELECT * FROM (VALUES ('identity', TRUE, 'name', 0), ('financials', TRUE, 'price', 1), ('financials', TRUE, 'revenue', 2), ('financials', TRUE, 'debt', 3), ('risks', FALSE, 'risk', 4)) t(section, blocking, field, i)) SELECT s_suppkey, section, blocking, string_agg(field, ',' ORDER BY i) AS missing FROM supplier, f WHERE s_suppkey % (i + 2) = 0 GROUP BY 1, 2, 3",
    "committee_chair": """WITH g AS (SELECT p_partkey, p_partkey % 3 <> 0 AS a, p_partkey % 5 <> 1 AS b, p_partkey % 4 <> 2 AS c, p_partkey % 7 <> 3 AS d, p_partkey % 6 <> 5 AS e, p_size % 7 AS bull, p_size % 5 AS bear, p_partkey % 19 = 0 AS mock, p_size % 6 + 1 AS tier FROM part),
        h AS (SELECT *, a::INT + b::INT + c::INT + d::INT + e::INT AS gates, CASE WHEN bull > bear + 1 THEN 'bullish' WHEN bear > bull + 1 THEN 'bearish' WHEN bull + bear = 0 THEN 'unknown' ELSE 'balanced' END AS balance FROM g)
        SELECT p_partkey, gates, balance, CASE WHEN mock THEN 'incomplete' WHEN tier >= 5 THEN 'needs_primary_sources' WHEN NOT b THEN 'rejected' WHEN NOT e THEN 'incomplete' WHEN gates >= 3 AND balance <> 'unknown' THEN 'candidate_for_review' ELSE 'deeper_analysis' END AS committee_status FROM h""",
    "gap_attribution": "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red|blue|green') THEN CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'not available' END WHEN regexp_matches(p_name, 'small|large') THEN CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'not available' END ELSE p_name END AS gap_text FROM part",
    "claim_scopes": r"""WITH c AS (SELECT conv_id * 100 + turn AS claim_id, CAST(len(regexp_extract_all(coalesce(text, '') || ' ' || turn || ' ' || conv_id, '\d[\d.,]*')) AS INTEGER) AS numbers, unnest([conv_id, conv_id + turn]) AS doc_id FROM conversations)
        SELECT claim_id, numbers, count(DISTINCT source) AS scopes, count(DISTINCT lang) AS periods, numbers >= 2 AND (count(DISTINCT source) > 1 OR count(DISTINCT lang) > 1) AS violation FROM c JOIN documents USING (doc_id) GROUP BY 1, 2""",
    "category_budget": f"""WITH RECURSIVE {FEED}, r AS (SELECT entity, event_class, event_id, row_number() OVER (PARTITION BY entity, event_class ORDER BY event_id) AS n FROM feed),
        k AS (SELECT *, n <= CASE event_class WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS reserved FROM r WHERE n <= CASE event_class WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 10 END),
        o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY NOT reserved, event_id) AS i, event_class IN ('view', 'click') AS grp, event_class IN ('click', 'purchase') AS grp2 FROM k),
        walk AS (SELECT entity, i, event_class, event_id, 1 AS kept, grp::INT AS shared, grp2::INT AS shared2, TRUE AS taken FROM o WHERE i = 1
          UNION ALL SELECT o.entity, o.i, o.event_class, o.event_id, kept + fits::INT, shared + (fits AND grp)::INT, shared2 + (fits AND grp2)::INT, fits FROM (SELECT walk.kept, walk.shared, walk.shared2, o.*, kept < 10 AND (NOT grp OR shared < 5) AND (NOT grp2 OR shared2 < 4) AS fits FROM walk JOIN o ON o.entity = walk.entity AND o.i = walk.i + 1) o)
        SELECT entity, event_id, event_class, CAST(kept - 1 AS INTEGER) AS place FROM walk WHERE taken""",
    "news_query_plan": "SELECT s_suppkey, unnest(range(4))::INTEGER AS n, unnest([s_name || ' results', s_name || ' ' || n_name, n_name || ' industry', n_name || ' regulation']) AS query FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "brand_domains": f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), r AS (SELECT *, split_part(host, '.', 1) AS root, replace(host, '-', '') AS bare FROM h)
        SELECT page_id, host, len(list_filter(['blog', 'ther'], lambda t: contains(root, t) OR contains(t, root) OR contains(bare, t))) > 0 AS brand, ends_with(host, 'example.org') AS trusted, contains(host, 'spam') AS low_quality FROM r""",
    "identity_checks": """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 't' || s_suppkey || '.US' WHEN s_suppkey % 7 = 0 THEN ' ' ELSE s_name END AS name, 'T' || s_suppkey AS ticker FROM supplier)
        SELECT s_suppkey, s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 AS placeholder, TRUE AS same, regexp_replace(regexp_replace(lower(name || ' ' || ticker), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM s""",
    "json_extraction": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events",
    "lineage_resolution": """WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS rule, o_orderdate FROM orders), b AS (SELECT o_custkey, min(rule) AS rule FROM o GROUP BY 1),
        n AS (SELECT * FROM o JOIN b USING (o_custkey, rule) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_custkey AS o_custkey, rule, o_orderkey FROM customer LEFT JOIN n ON c_custkey = o_custkey""",
    "provenance_counts": "SELECT o_custkey, count(DISTINCT o_orderkey) AS attempts, count(DISTINCT l_partkey) AS documents, count(l_partkey) AS links, count(DISTINCT l_suppkey) AS issuers FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'N') ON l_orderkey = o_orderkey GROUP BY 1",
    "country_regions": "SELECT c_mktsegment, min_by(n_regionkey, c_custkey) AS first_region, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "chair_actions": "SELECT s_nationkey, CASE WHEN s_acctbal < 0 THEN 'drop' WHEN s_acctbal < 5000 THEN 'watch' ELSE 'advance' END AS action, count(*) AS n, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS suppliers FROM supplier GROUP BY 1, 2",
    "evidence_inventory": "SELECT source, count(*) AS \"references\", count(quality) AS extracted, count(*) FILTER (quality = 1) AS validated, count(*) FILTER (quality IS NULL) AS metadata_only, count(*) FILTER (toxic = 1) AS failed, count(DISTINCT lang) AS languages FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "fact_dedup": "SELECT l_partkey || '|' || lower(l_returnflag) || '|' || lower(l_linestatus) || '|' || printf('%.4f', l_quantity) AS fact_key, min(l_orderkey) AS first_order, count(*) AS copies FROM lineitem GROUP BY 1",
    "document_get_or_create": """WITH d AS (SELECT doc_id, sha1(coalesce(text, '')) AS hash FROM documents), o AS (SELECT hash, min(doc_id) AS old FROM d WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT hash, min(doc_id) AS new, count(*) AS requests FROM d WHERE doc_id % 2 = 1 GROUP BY 1)
        SELECT hash, coalesce(old, new) AS doc_id, requests, CASE WHEN old IS NULL THEN 'inserted' ELSE 'reused' END AS action FROM n LEFT JOIN o USING (hash)""",
    "event_dates": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(ts AS DATE) END AS day FROM events",
    "exchange_attributes": """SELECT c_custkey, r_name AS region, CASE r_name WHEN 'EUROPE' THEN 'EUR' WHEN 'AMERICA' THEN 'USD' ELSE 'LOCAL' END AS quote_currency, CASE WHEN c_custkey % 10 = 0 THEN 'mock' WHEN c_acctbal > 0 THEN 'real' ELSE 'unknown' END AS provenance,
        CASE WHEN c_custkey % 700 BETWEEN 100 AND 599 THEN ((c_custkey % 700) // 100) || 'xx' ELSE 'unknown' END AS http_class FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "thesis_parse": """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), f AS (SELECT doc_id,
          list_filter([CASE WHEN contains(t, 'the ') THEN 'trade' END, CASE WHEN contains(t, 'tion') THEN 'motion' END, CASE WHEN contains(t, 'und ') THEN 'union' END], lambda x: x IS NOT NULL) AS a,
          list_filter([CASE WHEN contains(t, ' les ') THEN 'europe' END, CASE WHEN contains(t, ' los ') THEN 'south' END, CASE WHEN contains(t, ' der ') THEN 'north' END], lambda x: x IS NOT NULL) AS b,
          list_filter([CASE WHEN contains(t, 'without ') THEN 'without' END, CASE WHEN contains(t, 'sans ') THEN 'sans' END], lambda x: x IS NOT NULL) AS c FROM d)
        SELECT doc_id, array_to_string(a, ',') AS theme, array_to_string(b, ',') AS region, array_to_string(c, ',') AS exclusion, least(1.0::DOUBLE, (len(a) + len(b) + len(c)) / 8.0::DOUBLE) AS confidence, len(a) <> 1 AS needs_narrowing FROM f""",
    "sector_match": """WITH m AS (SELECT * FROM (VALUES ('economy', 'consumer'), ('standard', 'consumer'), ('promo', 'consumer'), ('small', 'industrial'), ('medium', 'industrial'), ('large', 'energy')) t(a, s)),
        p AS (SELECT p_partkey, lower(p_type) AS v, ['', 'promo', 'small', 'burnished'][p_partkey % 4 + 1] AS w FROM part)
        SELECT p_partkey, x.s AS sector, w = '' OR coalesce(x.s = y.s, v = w) AS matches FROM p LEFT JOIN m x ON x.a = v LEFT JOIN m y ON y.a = w""",
    "qualifying_facts": """WITH f AS (SELECT l_partkey, ['revenue', 'income', 'employees'][l_linenumber % 3 + 1] AS field, CASE WHEN l_tax > 0.02::DOUBLE THEN l_quantity END AS value, l_discount > 0.05::DOUBLE AS high, l_returnflag <> 'R' AS ok, l_orderkey, l_linenumber, l_quantity FROM lineitem)
        SELECT l_partkey, field, value, l_orderkey AS order_key FROM f WHERE field <> 'employees' AND value IS NOT NULL AND high AND ok QUALIFY row_number() OVER (PARTITION BY l_partkey, field ORDER BY l_orderkey, l_linenumber, l_quantity) = 1""",
    "comparable_cascade": """WITH n AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1), r AS (SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN orders IS NULL THEN 'no_analysis' WHEN done = 0 THEN 'draft_only' WHEN c_acctbal < 500 THEN 'not_valid' END AS reason FROM customer LEFT JOIN n ON c_custkey = o_custkey)
        SELECT c_custkey, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY c_nationkey, reason IS NULL ORDER BY c_acctbal DESC, c_custkey) > 10 THEN 'over_cap' ELSE 'comparable' END AS reason FROM r""",
    "price_provenance": """WITH l AS (SELECT l_suppkey, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1)
        SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE 'snapshot' END END AS provider, CASE WHEN s_suppkey % 4 > 0 THEN 'T5' END AS tier, CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 5 > 0 THEN 'USD' END AS currency, CASE WHEN s_suppkey % 4 > 0 THEN last END AS as_of, CASE WHEN s_suppkey % 4 > 0 THEN 'available' ELSE 'unavailable' END AS status
        FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey""",
    "evidence_pack": """WITH c AS (SELECT s_nationkey AS k, 1 AS priority, s_name AS item, s_acctbal AS weight FROM supplier UNION ALL SELECT c_nationkey, 2, c_name, c_acctbal FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, weight DESC, item) AS n FROM c)
        SELECT k, priority, item, weight, 'E' || n AS label FROM n WHERE n <= 12""",
    "snapshot_compose": f"""WITH {TREND}, x AS (SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 3000 THEN s_acctbal END AS balance, last_close, return_6m, momentum_label FROM supplier LEFT JOIN (SELECT * FROM trend WHERE instrument % 6 > 0) ON s_suppkey = instrument)
        SELECT *, array_to_string(list_filter([CASE WHEN s_name IS NULL THEN 's_name' END, CASE WHEN balance IS NULL THEN 'balance' END, CASE WHEN last_close IS NULL THEN 'last_close' END, CASE WHEN return_6m IS NULL THEN 'return_6m' END, CASE WHEN momentum_label IS NULL THEN 'momentum_label' END], lambda v: v IS NOT NULL), ',') AS missing FROM x""",
    "weak_datapoints": """WITH d AS (SELECT p_partkey, unnest(['revenue', 'name', 'debt']) AS field, CASE WHEN p_partkey % 5 > 0 THEN 'T' || (p_size % 6 + 1) END AS tier FROM part)
        SELECT p_partkey, field, tier, CASE WHEN tier IS NULL THEN 'unsourced' ELSE 'weak_source' END AS warning FROM d WHERE tier IS NULL OR (field <> 'name' AND tier NOT IN ('T1', 'T2'))""",
    "grid_facts": f"""WITH {FACTS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fy) AS n FROM facts), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fy) AS c FROM n WHERE n <= 3 AND gross IS NOT NULL)
        SELECT entity, label, CAST(c AS INTEGER) AS "column", CASE WHEN n <> 2 THEN fy END AS period, value, CASE WHEN n = 2 THEN 'excerpt_only' ELSE 'candidate' END AS status FROM (SELECT entity, 'revenue' AS label, c, n, fy, revenue AS value FROM k UNION ALL SELECT entity, 'gross', c, n, fy, gross FROM k)""",
    "report_join": "SELECT c_nationkey, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "excerpt_ranking": rf"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS raw, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) - 1 AS block_no FROM documents), b AS (SELECT doc_id, block_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM p), l AS (SELECT *, lower(text) AS low FROM b WHERE length(text) >= 40),
        c AS (SELECT doc_id, block_no, text, {_RELEVANCE} AS relevance, {', '.join(f'{_hits(w)} AS {n}' for n, w in _CLASSES.items())} FROM l),
        k AS (SELECT doc_id, block_no, relevance, CASE WHEN financial >= 1 AND financial >= risk THEN 'financial' WHEN risk >= 1 THEN 'risk' WHEN business >= 1 THEN 'business' ELSE 'general' END AS kind,
               substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 160) AS beg, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) = 1 AS lead FROM c),
        d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, beg ORDER BY lead DESC, relevance DESC, block_no) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lead, kind ORDER BY relevance DESC, block_no) AS rnd FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lead DESC, rnd, relevance DESC, block_no) AS place FROM r)
        SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, CAST(relevance AS INTEGER) AS relevance, kind, lead, CAST(place AS INTEGER) AS place FROM o WHERE place <= 8""",
    "flat_budget": rf"""WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS size, lower(text) AS low, text FROM documents WHERE text IS NOT NULL), f AS (SELECT source, doc_id, size, {_RELEVANCE} AS relevance FROM d QUALIFY row_number() OVER (PARTITION BY source, substr(sha1(trim(low)), 1, 16) ORDER BY doc_id) = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) AS place FROM f),
        walk AS (SELECT source, doc_id, size, relevance, place, size AS used, 1 AS n, TRUE AS kept FROM o WHERE place = 1
          UNION ALL SELECT o.source, o.doc_id, o.size, o.relevance, o.place, CASE WHEN used + o.size <= 20000 AND n < 10 THEN used + o.size ELSE used END, CASE WHEN used + o.size <= 20000 AND n < 10 THEN n + 1 ELSE n END, used + o.size <= 20000 AND n < 10 FROM walk JOIN o ON o.source = walk.source AND o.place = walk.place + 1)
        SELECT source, doc_id, CAST(size AS INTEGER) AS size, CAST(relevance AS INTEGER) AS relevance, 'E' || n AS label FROM walk WHERE kept""",
    "symbol_builder": "SELECT s_suppkey, 't' || s_suppkey || '.' || CASE r_name WHEN 'AFRICA' THEN 'af' WHEN 'AMERICA' THEN 'us' WHEN 'ASIA' THEN 'as' WHEN 'EUROPE' THEN 'eu' ELSE 'us' END AS symbol FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "lei_records": "SELECT c_custkey, 'LEI0' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || CASE WHEN c_custkey % 4 = 0 THEN 'XX' ELSE '42' END AS lei, c_custkey % 4 > 0 AS valid, c_name AS name, c_nationkey AS country FROM customer",
    "source_gaps": "SELECT c_nationkey, source, count(*) AS gaps FROM customer, (SELECT unnest(['1-URGENT', '5-LOW']) AS source) s WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = source AND o_totalprice > 250000) GROUP BY 1, 2",
    "brand_tokens": """WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' Holding Inc. ' || p_name || ' ' || p_type), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ('inc', 'corp', 'ltd', 'plc', 'holding', 'group', 'company', 'customer', 'supplier')) AS a FROM part)
        SELECT p_partkey, array_to_string(list_filter(a, lambda v, i: list_position(a, v) = i), ' ') AS tokens FROM t""",
    "document_kinds": r"""WITH x AS (SELECT page_id, lower(['Annual report', 'half-year figures', 'Results 2001', 'Slides', 'Home'][page_id % 5 + 1] || ' ' || url) AS t FROM pages)
        SELECT CASE WHEN regexp_matches(t, 'annual|10-k') THEN 'annual_report' WHEN regexp_matches(t, 'interim|half-year|10-q') THEN 'interim_report' WHEN regexp_matches(t, 'results|earnings') THEN 'results_release' WHEN regexp_matches(t, 'presentation|slides') THEN 'presentation' ELSE 'other' END AS kind, count(*) AS n, CAST(min(CASE WHEN page_id % 2 = 0 THEN -(page_id % 30 + 1990) ELSE 10000 END) AS INTEGER) AS newest FROM x GROUP BY 1""",
    "fact_scopes": """WITH h AS (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN p_type || ' Segment' WHEN 1 THEN 'group' ELSE CASE WHEN p_partkey % 2 = 0 THEN p_type END END AS scope FROM part)
        SELECT p_partkey, scope, CASE WHEN coalesce(scope, 'group') <> 'group' THEN 'segment' ELSE ['topline', 'earnings', 'earnings', 'cash', 'position', 'other'][p_partkey % 6 + 1] END AS category, CASE WHEN p_partkey % 5 > 0 THEN least(p_size + least((p_partkey % 5) * 15, 45), 95) ELSE p_size END AS credit FROM h""",
    "gap_lists": """WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k, count(*) AS n FROM orders GROUP BY 1, 2)
        SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY k) AS labels, CAST(count(*) AS INTEGER) AS n_labels, CAST(sum(n) AS INTEGER) AS n_all FROM f GROUP BY 1""",
    "narration": f"""WITH {FACTS} SELECT entity, fy, CASE WHEN gross IS NULL THEN fy || ': no lines' ELSE fy || ': revenue ' || format('{{:,.2f}}', round(revenue / 1000000, 6)) || 'm over ' || CAST(orders AS INTEGER) || ' orders' END AS summary FROM facts""",
}
