"""SQL of the fact queries: what their passages state, by construction."""

from tessera.plans.fact_queries import APART, HEADS, PROSE, ROWS, STATEMENTS

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_quoted, xs)) + "]"
_word = lambda words: f"regexp_matches(lower(t), '(^|[^a-z])({words})([^a-z]|$)')"
_CURRENCY = f"""CASE WHEN {_word('euro|euros|eur')} OR contains(t, '€') THEN 'EUR' WHEN {_word('swiss franc|swiss francs|chf')} THEN 'CHF' WHEN {_word('sterling|pound|pounds|gbp')} OR contains(t, '£') THEN 'GBP'
    WHEN {_word('danish krone|kroner|dkk')} THEN 'DKK' WHEN {_word('us dollar|us dollars|usd|dollars')} OR contains(t, '$') THEN 'USD' END"""
_YEAR = r"nullif(regexp_extract(t, '(?:^|[^\p{L}\p{N}_])((?:19|20)[0-9]{2})(?:[^\p{L}\p{N}_]|$)', 1), '')"

SQL = {
    "prose_facts": f"""WITH d AS (SELECT doc_id, doc_id % 12 AS k, doc_id * 7 % 9000 + 1000 AS v, format('{{:,}}', doc_id * 7 % 9000 + 1000) AS x, coalesce(text, '') || {_quoted(APART)} AS t FROM documents
        ), e AS (SELECT *, {_YEAR} AS year, {_CURRENCY} AS money FROM d
        ), f AS (
          SELECT doc_id, 'revenue' AS label, 'Revenue for the first half of 2026 came to €' || x || ' million' AS raw, v AS value, 'million' AS scale, 'EUR' AS currency, '2026' AS period, NULL AS scope FROM e WHERE k = 0
          UNION ALL SELECT doc_id, 'revenue', 'Sales increased by 5% at actual exchange rates to EUR' || x || ' million', v, 'million', 'EUR', '2025', NULL FROM e WHERE k = 1
          UNION ALL SELECT doc_id, 'operating_profit', 'Operating profit for the year grew by 1% to €' || x || ' thousand', v, 'thousand', 'EUR', year, NULL FROM e WHERE k = 2
          UNION ALL SELECT doc_id, 'revenue', 'revenue in 2024 was $ ' || x || 'bn', v, 'billion', 'USD', '2024', NULL FROM e WHERE k = 3
          UNION ALL SELECT doc_id, 'operating_profit', 'operating profit was £' || x || ' million', v, 'million', 'GBP', year, NULL FROM e WHERE k = 4
          UNION ALL SELECT doc_id, 'revenue', 'sales of CHF ' || x || ' million', v, 'million', 'CHF', '2023', 'Watch Makers' FROM e WHERE k = 6
          UNION ALL SELECT doc_id, 'free_cash_flow', 'Free cash flow fell by 3% to ' || x || ' million', v, 'million', money, year, NULL FROM e WHERE k = 8
          UNION ALL SELECT doc_id, 'operating_free_cash_flow', 'operating free cash flow reached ' || x || ' million', v, 'million', money, year, NULL FROM e WHERE k = 8
          UNION ALL SELECT doc_id, 'operating_profit', 'operating profit to €' || x || ' million', v, 'million', 'EUR', '2021', 'Fine Goods' FROM e WHERE k = 10
        )
        SELECT doc_id, label, raw, CAST(value AS DOUBLE) AS value, 'currency_amount' AS unit, scale, currency, period, scope, CASE WHEN currency IS NULL THEN 'medium' ELSE 'high' END AS confidence FROM f
        UNION ALL SELECT doc_id, 'operating_margin', 'Operating margin rose 120 basis points to ' || x || '%', v, 'percent', NULL, NULL, year, NULL, 'high' FROM e WHERE k = 7
        UNION ALL SELECT doc_id, 'employees', x, v, 'people', NULL, NULL, NULL, NULL, 'medium' FROM e WHERE k = 9
        UNION ALL SELECT doc_id, 'fiscal_year', '2022', 2022, 'year', NULL, NULL, '2022', NULL, 'high' FROM e WHERE k = 9""",
    "page_facts": """WITH p AS (SELECT page_id, page_id % 6 AS k, page_id * 37 % 9000 + 1000 AS v, (page_id // 6) % 2 = 1 AS two, page_id % 10 <> 7 AS known FROM pages
        ), f AS (
          SELECT page_id, known, 'revenue' AS label, '2024' AS period, 2 AS n, two AS several, CASE WHEN k = 0 THEN 'validated' WHEN two THEN 'rejected' ELSE 'excerpt_only' END AS status, CASE WHEN k = 0 OR NOT two THEN v END AS value,
            'currency_amount' AS unit, 'EUR' AS currency, 'million' AS scale, CASE WHEN k = 1 THEN 0.7 WHEN two THEN 0.95 ELSE 0.9 END AS confidence, 'html' AS method FROM p WHERE k IN (0, 1)
          UNION ALL SELECT page_id, known, 'revenue', '2023', 1, false, 'validated', v - 500, 'currency_amount', 'EUR', 'million', 0.8, 'html' FROM p WHERE k IN (0, 1)
          UNION ALL SELECT page_id, known, 'fiscal_year', '2024', 1, false, 'validated', 2024, 'year', NULL, NULL, 0.9, CASE WHEN two THEN 'native_pdf' ELSE 'html' END FROM p WHERE k IN (0, 1)
          UNION ALL SELECT page_id, known, label, period, 1, false, CASE WHEN label = 'total_debt' AND period = '2024' THEN 'excerpt_only' ELSE 'validated' END, CASE WHEN period = '2024' THEN CASE label WHEN 'total_debt' THEN 99000 ELSE v END ELSE CASE label WHEN 'total_debt' THEN 30.3 WHEN 'long_term_debt' THEN 20 ELSE 10 END END,
            'currency_amount', 'EUR', 'million', 0.8, 'html' FROM p, (SELECT unnest(['short_term_debt', 'long_term_debt', 'total_debt']) AS label), (SELECT unnest(['2024', '2023']) AS period) WHERE k = 2
          UNION ALL SELECT page_id, known, label, period, 1, false, CASE WHEN period = '2024' OR abs(v - (v - 500 + 400)) <= greatest(v * 0.01, 0.5) THEN 'validated' ELSE 'excerpt_only' END, CASE label WHEN 'total_assets' THEN v WHEN 'total_equity' THEN v - 500 ELSE CASE WHEN period = '2024' THEN 500 ELSE 400 END END,
            'currency_amount', 'EUR', 'million', 0.8, 'html' FROM p, (SELECT unnest(['total_assets', 'total_liabilities', 'total_equity']) AS label), (SELECT unnest(['2024', '2023']) AS period) WHERE k = 3
          UNION ALL SELECT page_id, known, 'operating_margin', '2024', 1, false, 'validated', 12.5, 'percent', NULL, NULL, 0.8, 'html' FROM p WHERE k = 4
          UNION ALL SELECT page_id, known, 'employees', period, 1, false, 'validated', CASE WHEN period = '2024' THEN v ELSE 12000 END, 'people', NULL, NULL, 0.8, 'html' FROM p, (SELECT unnest(['2024', '2023']) AS period) WHERE k = 4
          UNION ALL SELECT page_id, known, label, '2024', 1, false, 'validated', CASE WHEN label = 'revenue' THEN v ELSE v - 500 END, 'currency_amount', 'EUR', 'million', 0.9, CASE WHEN two THEN 'native_pdf' ELSE 'html' END FROM p, (SELECT unnest(['revenue', 'operating_profit']) AS label) WHERE k = 5
        )
        SELECT page_id, label, period, 'group' AS scope, CAST(n AS BIGINT) AS n, CASE WHEN several THEN 'html|native_pdf' ELSE method END AS methods, CASE WHEN status = 'validated' AND NOT known THEN 'excerpt_only' ELSE status END AS validation, CAST(value AS DOUBLE) AS value, unit, currency, scale, method, CAST(confidence AS DOUBLE) AS confidence FROM f""",
    "page_structure": f"""WITH p AS (SELECT page_id, page_id % 6 AS k, page_id * 37 % 9000 + 1000 AS v FROM pages
        ), r AS (SELECT page_id, {_list(HEADS)}[k + 1] AS head, format('{{:,}}', v) AS v, format('{{:,}}', v - 500) AS w, k FROM p
        ), b AS (SELECT page_id, CASE k WHEN 2 THEN ['Short-term debt|' || v || '|10', 'Long-term debt|' || v || '|20', 'Total debt|99,000|30.3'] WHEN 3 THEN ['Total assets|' || v || '|' || v, 'Total liabilities|500|400', 'Total equity|' || w || '|' || w]
            WHEN 4 THEN ['Operating margin|12.5%|11', 'Employees|' || v || '|12,000', 'Operating profit and revenue|5|6'] WHEN 5 THEN ['Other|1|2'] ELSE ['Revenue|' || v || '|' || w] END AS body, head FROM r
        ), rows AS (SELECT page_id, unnest(list_prepend(head || '|2024|2023', body)) AS text, unnest(range(len(body) + 1)) AS n FROM b)
        SELECT page_id, 'row' AS kind, 0 AS table_no, 0 AS n, NULL AS parent, 'Consolidated results' AS path, 'left of it|right' AS text FROM pages
        UNION ALL SELECT page_id, 'row', 1, n, 0, 'Consolidated results', text FROM rows
        UNION ALL SELECT page_id, 'heading', NULL, 0, NULL, 'Consolidated results', 'Consolidated results' FROM pages""",
}
assert len(STATEMENTS) == 12 and len(PROSE) == len(ROWS) == 6
