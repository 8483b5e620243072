"""Queries whose text Spark SQL and DuckDB share."""

from __future__ import annotations

SHARED = {
    "q04_duplicate_size_histogram": """
        WITH g AS (SELECT h, count(*) AS n FROM (SELECT md5(lower(text)) AS h FROM {documents}) t GROUP BY h HAVING count(*) >= 2),
        top AS (SELECT n FROM g ORDER BY n DESC LIMIT 20)
        SELECT count(*) AS groups_2, cast(coalesce(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END), 0) AS bigint) AS groups_3,
               cast(coalesce(sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END), 0) AS bigint) AS groups_5, cast(coalesce(sum(CASE WHEN n >= 10 THEN 1 ELSE 0 END), 0) AS bigint) AS groups_10,
               cast(coalesce(sum(n), 0) AS bigint) AS rows_2, cast(coalesce(sum(CASE WHEN n >= 5 THEN n ELSE 0 END), 0) AS bigint) AS rows_5, coalesce(max(n), 0) AS largest,
               cast((SELECT coalesce(sum(n), 0) FROM top) AS bigint) AS top20_rows FROM g""",
    "q05_duplicate_unique_counts": """
        SELECT count(*) AS row_count, count(DISTINCT md5(text)) AS exact_unique, count(DISTINCT md5(lower(text))) AS folded_unique, count(DISTINCT source) AS sources FROM {documents}""",
    "q22_split_summary": """
        SELECT CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, lang, source, count(*) AS n, cast(sum(n_chars) AS bigint) AS chars
        FROM {documents} GROUP BY CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END, lang, source""",
    "q26_first_user_last_assistant": """
        WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {conversations} WHERE role = 'user'),
        a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM {conversations} WHERE role = 'assistant'),
        c AS (SELECT DISTINCT conv_id FROM {conversations})
        SELECT c.conv_id, coalesce(u.text, '') AS prompt, coalesce(a.text, '') AS response
        FROM c LEFT JOIN (SELECT * FROM u WHERE k = 1) u ON c.conv_id = u.conv_id LEFT JOIN (SELECT * FROM a WHERE k = 1) a ON c.conv_id = a.conv_id""",
    "q29_completion_ordinal": """
        SELECT event_id, user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bigint) AS completion_id FROM {events}""",
    "q31_scalar_simd_ratio": """
        WITH c AS (SELECT l_partkey, max(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS scalar_time, max(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS simd_time
                   FROM {lineitem} GROUP BY l_partkey)
        SELECT l_partkey, scalar_time, simd_time, round(scalar_time / nullif(simd_time, 0), 6) AS speedup FROM c""",
    "q32_result_status": """
        SELECT CASE WHEN event_type = 'error' AND value > 50 THEN 'timed out' WHEN event_type = 'error' THEN 'failed' WHEN value IS NULL THEN 'missing' WHEN event_type = 'purchase' THEN 'passed' ELSE 'skipped' END AS status,
               count(*) AS n, min(event_id) AS first_event FROM {events}
        GROUP BY CASE WHEN event_type = 'error' AND value > 50 THEN 'timed out' WHEN event_type = 'error' THEN 'failed' WHEN value IS NULL THEN 'missing' WHEN event_type = 'purchase' THEN 'passed' ELSE 'skipped' END""",
    "q36_composite_distinct": """
        SELECT user_id, event_type, props, count(*) AS n, min(event_id) AS first_event FROM {events} GROUP BY user_id, event_type, props""",
    "q38_category_manifest": """
        SELECT CASE WHEN o.o_orderstatus = 'F' AND o.o_totalprice > 300000 THEN 'not_suitable' WHEN o.o_orderpriority = '1-URGENT' THEN 'holdout' WHEN c.c_acctbal < 0 THEN 'requires_context' WHEN o.o_orderstatus = 'P' THEN 'hybrid' ELSE 'pure' END AS category,
               c.c_mktsegment AS strategy, count(*) AS n, count(DISTINCT c.c_custkey) AS customers
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
        GROUP BY CASE WHEN o.o_orderstatus = 'F' AND o.o_totalprice > 300000 THEN 'not_suitable' WHEN o.o_orderpriority = '1-URGENT' THEN 'holdout' WHEN c.c_acctbal < 0 THEN 'requires_context' WHEN o.o_orderstatus = 'P' THEN 'hybrid' ELSE 'pure' END, c.c_mktsegment""",
    "q39_left_join_default": """
        WITH p AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) AS k FROM {labels})
        SELECT d.doc_id, coalesce(cast(p.quality AS varchar(9)), '') AS quality FROM {documents} d LEFT JOIN (SELECT * FROM p WHERE k = 1) p ON d.doc_id = p.doc_id""",
    "q40_keyed_first_wins": """
        WITH k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM {conversations})
        SELECT conv_id, role, turn, text FROM k WHERE r = 1""",
    "q41_overlay_coalesce": """
        SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'override' END, d.source) AS source, CASE WHEN l.quality = 0 THEN 'manual' ELSE 'passthrough' END AS origin
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "q50_arg_reduction": """
        WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM {lineitem})
        SELECT l_suppkey, l_orderkey AS best_order, l_linenumber AS best_line, l_extendedprice AS best_price FROM r WHERE k = 1""",
    "q51_histogram_update": """
        SELECT cast(floor(l_quantity / 10) AS bigint) AS bin, l_returnflag, count(*) AS n, sum(cast(l_extendedprice AS decimal(18, 2))) AS total FROM {lineitem} GROUP BY cast(floor(l_quantity / 10) AS bigint), l_returnflag""",
    "q52_gather_map": """
        SELECT l.l_orderkey, l.l_linenumber, p.p_brand, round(l.l_quantity * p.p_retailprice, 2) AS gathered FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE p.p_size < 10""",
    "q53_compact_filter": """
        SELECT l_orderkey, l_linenumber, l_quantity, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey) - 1 AS bigint) AS out_pos FROM {lineitem} WHERE l_quantity > 25""",
    "q54_adjacent_duplicates": """
        WITH a AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events})
        SELECT event_id, user_id, event_type FROM a WHERE event_type = before""",
    "q60_store_map": """
        SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity >= 25 THEN l_tax ELSE 0.0 END AS masked_tax FROM {lineitem} WHERE l_discount < 0.05""",
    "q61_scalar_reduction": """
        SELECT count(*) AS n, sum(cast(l_quantity AS decimal(18, 2))) AS quantity, max(l_extendedprice) AS top_price, min(l_shipdate) AS first_ship FROM {lineitem}""",
    "q62_nested_reduction": """
        SELECT c.c_mktsegment, count(*) AS orders, sum(cast(o.o_totalprice AS decimal(18, 2))) AS total FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""",
    "q63_reads_before_write": """
        WITH m AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN event_id END) AS first_read, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS first_write FROM {events} GROUP BY user_id)
        SELECT user_id, first_read, first_write FROM m WHERE first_write IS NOT NULL AND first_read <= first_write""",
    "q64_predicate_scan": """
        SELECT o.o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)""",
    "q65_validated_scan": """
        SELECT count(*) AS row_count, cast(sum(CASE WHEN doc_id IS NULL OR text IS NULL THEN 1 ELSE 0 END) AS bigint) AS invalid, cast(sum(CASE WHEN coalesce(trim(source), '') = '' THEN 1 ELSE 0 END) AS bigint) AS unsourced FROM {documents}""",
    "q66_integrity_anti_join": """
        SELECT l.doc_id FROM {labels} l LEFT JOIN {documents} d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL""",
    "q67_padding": """
        WITH n AS (SELECT conv_id, sum(length(text)) AS len FROM {conversations} GROUP BY conv_id)
        SELECT conv_id, cast(len AS bigint) AS len, cast(ceil(len / 8.0) * 8 AS bigint) AS padded FROM n""",
    "q68_risk_rollup": """
        SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM {documents} GROUP BY ROLLUP (lang, source)""",
    "q80_last_in_file": """
        WITH k AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM {events})
        SELECT user_id, event_type, event_id, value FROM k WHERE r = 1""",
    "q81_results_by_ordinal": """
        WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {events} WHERE event_type = 'view'),
        b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {events} WHERE event_type = 'click')
        SELECT a.event_id AS sample, b.event_id AS result, b.value FROM a JOIN b ON a.user_id = b.user_id AND a.k = b.k""",
    "q82_prior_initialiser": """
        WITH w AS (SELECT event_id, event_type, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {events})
        SELECT event_id, coalesce(cast(p AS varchar(20)), '0') AS prior FROM w WHERE event_type = 'purchase'""",
    "q83_two_left_lookups": """
        SELECT o.o_orderkey, coalesce(c.c_name, n.n_name, '') AS name, coalesce(n.n_nationkey, 0) AS row_index
        FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN {nation} n ON o.o_orderkey % 40 = n.n_nationkey""",
    "q84_four_key_override": """
        WITH m AS (SELECT l_returnflag, l_linestatus, l_linenumber, cast(l_quantity AS int) AS qty, min(l_orderkey) AS override FROM {lineitem} WHERE l_quantity < 5 GROUP BY l_returnflag, l_linestatus, l_linenumber, cast(l_quantity AS int))
        SELECT l.l_orderkey, l.l_linenumber, coalesce(m.override, l.l_partkey) AS chosen FROM {lineitem} l LEFT JOIN m ON l.l_returnflag = m.l_returnflag AND l.l_linestatus = m.l_linestatus AND l.l_linenumber = m.l_linenumber AND cast(l.l_quantity AS int) = m.qty""",
    "q85_same_array_dependency": """
        SELECT w.l_partkey AS base, w.l_linenumber AS write_index, r.l_linenumber AS read_index, count(*) AS pairs
        FROM {lineitem} w JOIN {lineitem} r ON w.l_partkey = r.l_partkey AND w.l_orderkey = r.l_orderkey AND w.l_linenumber <> r.l_linenumber AND w.l_linestatus = 'O' GROUP BY w.l_partkey, w.l_linenumber, r.l_linenumber""",
    "q86_type_vote": """
        WITH v AS (SELECT l_suppkey, l_returnflag AS type, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS score, min(l_orderkey) AS ord FROM {lineitem} GROUP BY l_suppkey, l_returnflag),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, ord, type DESC) AS k FROM v)
        SELECT l_suppkey, type, score FROM r WHERE k = 1""",
    "q87_reference_order": """
        SELECT p_size, p_partkey, cast(row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, p_brand, p_partkey) AS bigint) AS place FROM {part}""",
    "q88_begin_order_nulls_last": """
        SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 100 END, 1000000000), o_orderkey) AS bigint) AS place FROM {orders}""",
    "q89_event_interleave": """
        WITH u AS (SELECT o_orderkey AS k, o_orderkey % 10 AS begin_at, 0 AS kind, o_orderkey AS id FROM {orders} UNION ALL SELECT l_orderkey, l_partkey % 10, 1, l_linenumber FROM {lineitem})
        SELECT k, kind, id, begin_at, cast(row_number() OVER (PARTITION BY k ORDER BY begin_at, kind, id) AS bigint) AS place FROM u""",
    "q90_match_ordering": """
        SELECT s.s_nationkey AS benchmark, s.s_suppkey AS bench_id, n.n_regionkey AS core_id FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey ORDER BY benchmark, bench_id, core_id""",
    "q91_group_ordering": """
        WITH g AS (SELECT 'exact' AS kind, md5(text) AS h FROM {documents} UNION ALL SELECT 'folded', md5(lower(text)) FROM {documents})
        SELECT kind, h AS digest, count(*) AS n FROM g GROUP BY kind, h HAVING count(*) >= 2 ORDER BY kind, n DESC, digest""",
    "q92_input_order": """
        SELECT CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, doc_id AS line FROM {documents} ORDER BY CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END, doc_id""",
    "q93_union_of_datasets": """
        SELECT 'core' AS dataset, CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, doc_id AS id, cast(row_number() OVER (PARTITION BY source, CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END ORDER BY doc_id) AS bigint) AS row_index, source AS source_name FROM {documents}
        UNION ALL SELECT 'bench', 'benchmark', item_id, item_id + 1, '' FROM {benchmark}""",
    "q94_zero_filled_subtypes": """
        WITH d AS (SELECT 'A' AS type, 'F' AS subtype UNION ALL SELECT 'A', 'O' UNION ALL SELECT 'A', 'X' UNION ALL SELECT 'N', 'F' UNION ALL SELECT 'N', 'O' UNION ALL SELECT 'N', 'X' UNION ALL SELECT 'R', 'F' UNION ALL SELECT 'R', 'O' UNION ALL SELECT 'R', 'X'),
        n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} WHERE l_quantity > 48 GROUP BY l_returnflag, l_linestatus)
        SELECT d.type, d.subtype, coalesce(n.n, 0) AS n FROM d LEFT JOIN n ON d.type = n.l_returnflag AND d.subtype = n.l_linestatus""",
    "q95_name_subset": """
        WITH a AS (SELECT DISTINCT user_id, event_type FROM {events} WHERE value > 50), b AS (SELECT DISTINCT user_id, event_type FROM {events} WHERE value <= 50)
        SELECT a.user_id, sum(CASE WHEN b.event_type IS NULL THEN 1 ELSE 0 END) = 0 AS subset, cast(sum(CASE WHEN b.event_type IS NULL THEN 0 ELSE 1 END) AS bigint) AS common FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY a.user_id""",
    "q96_shape_match": """
        WITH a AS (SELECT DISTINCT p_type AS name, p_size % 3 AS shape FROM {part} WHERE p_size < 25), b AS (SELECT DISTINCT p_type AS name, p_size % 3 AS shape FROM {part} WHERE p_size >= 25)
        SELECT a.name, count(*) AS matches, cast(sum(CASE WHEN a.shape = b.shape THEN 1 ELSE 0 END) AS bigint) AS same_shape FROM a JOIN b ON a.name = b.name GROUP BY a.name""",
    "q97_audit_totals": """
        SELECT count(*) AS row_count, cast(sum(CASE WHEN n_chars >= 100 AND n_chars <= 10000 THEN 1 ELSE 0 END) AS bigint) AS passed, cast(sum(CASE WHEN n_chars >= 100 AND n_chars <= 10000 THEN 0 ELSE 1 END) AS bigint) AS failed, count(DISTINCT source) AS sources FROM {documents}""",
    "q98_style_counters": """
        SELECT o_orderstatus AS style, o_orderpriority AS pattern, count(*) AS n, cast(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS bigint) AS ast_ok FROM {orders} GROUP BY o_orderstatus, o_orderpriority""",
    "q109_first_rows": """
        SELECT user_id, event_id FROM {events} ORDER BY ts, event_id LIMIT 100""",
    "q111_first_match": """
        WITH b AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM {supplier})
        SELECT c.c_custkey, b.s_name AS first_supplier FROM {customer} c JOIN (SELECT * FROM b WHERE r = 1) b ON c.c_nationkey = b.s_nationkey""",
    "q114_pending_attribute": """
        WITH w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events})
        SELECT event_id, event_type, CASE WHEN before = 'signup' THEN 1 ELSE 0 END AS marked FROM w WHERE event_type <> 'signup'""",
    "q117_parent_cross_check": """
        WITH p AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {conversations})
        SELECT d.doc_id, coalesce(p.text, '') AS parent, CASE WHEN p.text IS NOT NULL AND length(p.text) <> d.n_chars THEN 'parent_mismatch' ELSE 'ok' END AS finding
        FROM {documents} d LEFT JOIN (SELECT * FROM p WHERE r = 1) p ON d.doc_id = p.conv_id""",
    "q118_unknown_samples": """
        SELECT e.event_id FROM {events} e LEFT JOIN {customer} c ON e.user_id = c.c_custkey WHERE c.c_custkey IS NULL""",
    "q119_error_counts": """
        SELECT event_type AS reason, count(*) AS n, min(event_id) AS first_event, cast(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS bigint) AS without_value, cast(sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS bigint) AS high FROM {events} GROUP BY event_type ORDER BY n DESC, first_event LIMIT 20""",
}
