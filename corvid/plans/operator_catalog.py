"""Queries of the sweep, the automaton of literal mentions, line brackets and nested assembly."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.operators import mentions, nesting, sweep
from corvid.plans.catalog import D_ORDERS, intervals
from corvid.plans.registry import query
from corvid.sources.tables import table


@query(f"""WITH {D_ORDERS}, p AS (SELECT l_orderkey * 10 + l_linenumber AS point, k, b + l_partkey % 300 AS pos FROM lineitem JOIN o ON o.id = l_orderkey)
        SELECT p.point, o.id AS interval, row_number() OVER (PARTITION BY p.point ORDER BY o.b DESC, o.e, o.id DESC) - 1 AS level FROM (SELECT point, k, min(pos) AS pos FROM p GROUP BY ALL) p JOIN o ON o.k = p.k AND o.b <= p.pos AND p.pos <= o.e""")
def q129_loops_of_references(spark, sf_dir):
    """All intervals that hold a reference, the innermost first: orders of a customer hold the places of their lines."""
    loops = intervals(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(loops.withColumnRenamed("id", "l_orderkey"), "l_orderkey")
    points = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point"), "k", (F.col("b") + F.col("l_partkey") % 300).alias("pos")).groupBy("point", "k").agg(F.min("pos").alias("pos"))
    return sweep.open_intervals(loops, points, "k", "b", "e", "id", "pos", "point").withColumn("level", F.col("level").cast("bigint"))


WORD = r"[\p{L}\p{N}_]+"


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS term FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS term FROM documents)
        SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM w JOIN (SELECT * FROM t WHERE length(term) >= 8) USING (term) GROUP BY term""")
def q130_word_mentions(spark, sf_dir):
    """Words of eight characters or more of the benchmark, looked for as whole words in all documents by one automaton."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("term")).where(F.length("term") >= 8)
    found = mentions.mentions(table(spark, sf_dir, "documents"), terms, "text", "term", "doc_id", words=True)
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("hits").alias("hits"))


#: Headers: the events of a user in order are the lines of a file, of which some open and close guarded blocks.
LINE = "CASE event_id % 7 WHEN 0 THEN '#if defined(FEATURE_' || CASE WHEN event_id % 3 = 0 THEN 'SME' ELSE 'BASE' END || ')' WHEN 2 THEN '#ifdef OLD' WHEN 3 THEN '  #endif' WHEN 5 THEN '#endif' ELSE 'decl ' || cast(event_id AS string) || CASE WHEN event_id % 11 = 0 THEN ' SME' ELSE '' END END"


@query(f"""WITH RECURSIVE l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, {LINE} AS value FROM events),
        s AS (SELECT user_id, 0::BIGINT AS line, '' AS value, 0 AS depth, 0 AS out_at, false AS gone, false AS cut FROM (SELECT DISTINCT user_id FROM l)
          UNION ALL SELECT l.user_id, l.line, l.value,
            CASE WHEN starts_with(l.value, '#if') THEN s.depth + 1 WHEN trim(l.value) = '#endif' THEN greatest(0, s.depth - 1) ELSE s.depth END,
            CASE WHEN s.out_at = 0 AND starts_with(l.value, '#if') AND contains(l.value, 'SME') THEN s.depth + 1 WHEN trim(l.value) = '#endif' AND s.out_at = s.depth THEN 0 ELSE s.out_at END,
            s.out_at > 0 OR (starts_with(l.value, '#if') AND contains(l.value, 'SME')), s.out_at = 0 AND starts_with(l.value, '#if') AND contains(l.value, 'SME')
          FROM s JOIN l ON l.user_id = s.user_id AND l.line = s.line + 1)
        SELECT user_id, coalesce(string_agg(value, chr(10) ORDER BY line) FILTER (NOT gone), '') AS kept, count(*) FILTER (gone) AS removed, count(*) FILTER (cut) AS blocks FROM s WHERE line > 0 GROUP BY user_id""")
def q131_guarded_headers(spark, sf_dir):
    """Every header without the blocks that an unwanted #if opens, and how many lines and blocks went."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    lines = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("line"), F.expr(LINE).alias("value"))
    bare = F.ltrim("value")
    found = nesting.without_blocks(lines, "user_id", "line", F.startswith(bare, F.lit("#if")), F.startswith(bare, F.lit("#endif")), F.contains("value", F.lit("SME")))
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("line", "value"))))
    return found.groupBy("user_id").agg(F.array_join(F.transform(kept, lambda x: x["value"]), "\n").alias("kept"), F.count_if("gone").alias("removed"), F.count_if("cut").alias("blocks"))


@query("""WITH o AS (SELECT o_custkey, string_agg('    loop o' || o_orderkey || ' {' || chr(10) || '    }', chr(10) ORDER BY o_orderkey DESC) AS t FROM orders GROUP BY o_custkey),
        c AS (SELECT c_nationkey, string_agg('  loop c' || c_custkey || ' {' || coalesce(chr(10) || t, '') || chr(10) || '  }', chr(10) ORDER BY c_custkey) AS t FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_nationkey)
        SELECT n_regionkey AS tree, string_agg('loop n' || n_nationkey || ' {' || coalesce(chr(10) || t, '') || chr(10) || '}', chr(10) ORDER BY n_nationkey) AS text FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def q132_nested_rendering(spark, sf_dir):
    """A region's loops over nations, customers and orders, the latter in falling order, three deep."""
    part = lambda name, id, parent, order: [F.concat(F.lit(name), F.col(id).cast("string")).alias("id"), parent.alias("parent"), order.cast("long").alias("order")]
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    tree = F.col("n_regionkey").alias("tree")
    under = lambda name, id: F.concat(F.lit(name), F.col(id).cast("string"))
    customers = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = o.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = n.select(tree, *part("n", "n_nationkey", F.lit(None).cast("string"), F.col("n_nationkey")))
    rows = rows.unionByName(customers.select(tree, *part("c", "c_custkey", under("n", "n_nationkey"), F.col("c_custkey"))))
    rows = rows.unionByName(orders.select(tree, *part("o", "o_orderkey", under("c", "c_custkey"), -F.col("o_orderkey"))))
    return nesting.assembled(rows.withColumns({"head": F.concat(F.lit("loop "), "id", F.lit(" {")), "tail": F.lit("}")}), "tree", "id", "parent", "order", "head", "tail")
