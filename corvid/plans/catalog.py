"""The query catalog: Spark queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import features, text
from corvid.operators import evaluation, mentions, ordering, similarity
from corvid.plans.registry import QUERIES, SQL, query, shared  # noqa: F401  the first two for callers
from corvid.plans.relational import SHARED
from corvid.sources.tables import materialize, table

for _name, _sql in SHARED.items():
    shared(_name, _sql)

# DuckDB: tokens, shingles (at least `least` per row) and similar pairs of documents and benchmark items.
D_TOKEN = r"[a-z_][\p{L}\p{N}_]*|[0-9]+"


def d_shingles(name: str, source: str, id: str, least: int = 8) -> str:
    return rf"""{name}_l AS MATERIALIZED (SELECT {id}, regexp_extract_all(lower(text), '{D_TOKEN}') AS l FROM {source}),
        {name}_t AS MATERIALIZED (SELECT {id}, len(l) AS c, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM {name}_l),
        {name}_w AS (SELECT {id}, c, p, t, concat_ws(' ', t, lead(t, 1) OVER w, lead(t, 2) OVER w, lead(t, 3) OVER w, lead(t, 4) OVER w) AS g FROM {name}_t WINDOW w AS (PARTITION BY {id} ORDER BY p)),
        {name}_d AS MATERIALIZED (SELECT DISTINCT {id}, CASE WHEN c < 5 THEN t ELSE g END AS s FROM {name}_w WHERE c < 5 OR p <= c - 4),
        {name}_n AS MATERIALIZED (SELECT {id}, count(*) AS n FROM {name}_d GROUP BY {id} HAVING count(*) >= {least})"""


D_PAIRS = f"""WITH {d_shingles('a', 'documents', 'doc_id')}, {d_shingles('b', 'benchmark', 'item_id')},
        pairs AS MATERIALIZED (SELECT doc_id, item_id, na.n AS n_a, nb.n AS n_b, count(*) AS shared, count(*) / (na.n + nb.n - count(*)) AS jaccard, count(*) / least(na.n, nb.n) AS containment
          FROM a_d JOIN b_d USING (s) JOIN a_n na USING (doc_id) JOIN b_n nb USING (item_id) GROUP BY doc_id, item_id, na.n, nb.n)"""


def docs_and_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = docs_and_items(spark, sf_dir)
    return similarity.set_overlap(similarity.shingle_rows(docs, "doc_id", least=8, hashed=True), similarity.shingle_rows(items, "item_id", least=8, hashed=True), "doc_id", "item_id")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("jaccard", "containment")})


@query(D_PAIRS + " SELECT doc_id, item_id, shared, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM pairs WHERE jaccard >= 0.8 OR containment >= 0.95")
def q01_shingle_containment(spark, sf_dir):
    docs, items = docs_and_items(spark, sf_dir)
    return rounded(similarity.contaminated_pairs(docs, items).select("doc_id", "item_id", "shared", "jaccard", "containment"))


@query(rf"""WITH c AS (SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '{D_TOKEN}'), ' ')) AS h FROM documents)
        SELECT x.doc_id, y.doc_id AS first_doc FROM c x JOIN (SELECT h, min(doc_id) AS doc_id FROM c GROUP BY h) y USING (h) WHERE x.doc_id <> y.doc_id AND h <> sha256('')""")
def q02_exact_text_match(spark, sf_dir):
    # Digests are worked out once and written; a text without a token has none.
    docs = text.barrier(table(spark, sf_dir, "documents").select("doc_id", text.canonical(F.col("text")).alias("c")), "c").where("c <> ''")
    docs = materialize(docs.select("doc_id", F.unhex(F.sha2("c", 256)).alias("h")))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(first, "h").where("doc_id <> first_doc").select("doc_id", "first_doc")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, md5(lower(text)) AS h FROM documents),
        g AS (SELECT h, count(*) AS n, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'dev') AS dev_rows, min(doc_id) AS first_doc FROM d GROUP BY h HAVING count(*) >= 2),
        s AS (SELECT h, source, count(*) AS k, min(doc_id) AS f FROM d GROUP BY h, source),
        t AS (SELECT h, string_agg(source || ':' || k, ';' ORDER BY k DESC, f) AS top_sources FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY k DESC, f) AS r FROM s) WHERE r <= 5 GROUP BY h),
        i AS (SELECT h, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS first_ids FROM (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM d) WHERE r <= 12 GROUP BY h)
        SELECT g.h AS digest, n, train_rows, dev_rows, first_doc, top_sources, first_ids FROM g JOIN t USING (h) JOIN i USING (h)""")
def q03_duplicate_groups(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 == 0, "dev").otherwise("train")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", split.alias("split"), F.md5(F.lower("text").cast("binary")).alias("digest"))
    # Top lists are cut by ranks before they are gathered, so a list holds 5 sources or 12 ids at most.
    groups = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "dev").alias("dev_rows"), F.min("doc_id").alias("first_doc")).where("n >= 2")
    by_source = docs.groupBy("digest", "source").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("f"))
    by_source = by_source.withColumn("r", F.row_number().over(W.partitionBy("digest").orderBy(F.desc("k"), "f"))).where("r <= 5")
    top = by_source.groupBy("digest").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "source", "k").alias("v")))), lambda x: x["v"]), ";").alias("top_sources"))
    ids = docs.withColumn("r", F.row_number().over(W.partitionBy("digest").orderBy("doc_id"))).where("r <= 12")
    ids = ids.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_ids"))
    return groups.join(top, "digest").join(ids, "digest")


@query(r"""WITH p AS (SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' TAG ', 'g'), '[0-9]+', 'NUM', 'g'), '\s+', ' ', 'g')) AS h FROM pages)
        SELECT h AS digest, count(*) AS n, min(page_id) AS first_page FROM p GROUP BY h""")
def q06_normalized_structure_match(spark, sf_dir):
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " TAG "), "[0-9]+", "NUM"), r"\s+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(c, 256).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query(rf"""SELECT doc_id, len(regexp_extract_all(lower(text), '{D_TOKEN}')) AS tokens, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[A-Za-z]+\(')) AS calls FROM documents""")
def q07_token_counts(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(c)).cast("bigint").alias("tokens"), text.count_of(c, "[0-9]+").alias("numbers"), text.count_of(c, r"[A-Za-z]+\(").alias("calls"))


D_H = "('0x' || substr(md5({}), 1, 15))::BIGINT"


@query()
def q09_minhash_blake2b(spark, sf_dir):
    docs, items = docs_and_items(spark, sf_dir)
    both = docs.select(F.lit("core").alias("dataset"), F.col("doc_id").alias("id"), "text").unionByName(items.select(F.lit("bench").alias("dataset"), F.col("item_id").alias("id"), "text"))
    toks = text.barrier(both.select("dataset", "id", text.tokens(F.col("text")).alias("t")), "t")
    return toks.select("dataset", "id", similarity.blake_text_signatures(F.array_join("t", " ")).alias("s")).select("dataset", "id", F.col("s.minhash").alias("minhash"), F.col("s.simhash").alias("simhash"))


@query()
def q11_edit_similarity(spark, sf_dir):
    docs, items = docs_and_items(spark, sf_dir)
    hits = similarity.contaminated_pairs(docs, items)
    a = docs.select("doc_id", text.tokens(F.col("text")).alias("ta"))
    b = items.select("item_id", text.tokens(F.col("text")).alias("tb"))
    near = hits.join(a, "doc_id").join(b, "item_id").where(F.least(F.size("ta"), F.size("tb")) <= 3000)
    scored = text.barrier(near.select("doc_id", "item_id", similarity.edit_ratio("ta", "tb").alias("edit_similarity")), "edit_similarity")
    return scored.where("edit_similarity >= 0.88").withColumn("edit_similarity", F.round("edit_similarity", 6))


@query(D_PAIRS + " SELECT item_id, doc_id, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM pairs) WHERE rank <= 2000")
def q12_topk_candidates(spark, sf_dir):
    return similarity.top_candidates(pairs(spark, sf_dir), 2000).select("item_id", "doc_id", "shared", F.col("rank").cast("bigint").alias("rank"))


@query(D_PAIRS + " SELECT item_id, doc_id, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM pairs WHERE jaccard >= 0.86 OR containment >= 0.92 ORDER BY item_id, jaccard DESC, containment DESC, doc_id")
def q13_top_similar(spark, sf_dir):
    hits = pairs(spark, sf_dir).where("jaccard >= 0.86 OR containment >= 0.92").orderBy("item_id", F.desc("jaccard"), F.desc("containment"), "doc_id")
    return rounded(hits.select("item_id", "doc_id", "jaccard", "containment"))


@query(r"""WITH f AS (SELECT page_id, concat_ws('|', len(regexp_extract_all(html, '<p')), len(regexp_extract_all(html, '<li')), len(regexp_extract_all(html, '<a ')), len(regexp_extract_all(html, '<h[1-6]')), (html LIKE '%<table%')::INT) AS key FROM pages)
        SELECT key, sha256(key) AS digest, count(*) AS n FROM f GROUP BY key""")
def q14_semantic_hash_match(spark, sf_dir):
    c = F.col("html")
    key = F.concat_ws("|", *(text.count_of(c, p) for p in ("<p", "<li", "<a ", "<h[1-6]")), F.contains(c, F.lit("<table")).cast("int"))
    return table(spark, sf_dir, "pages").select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.sha2("key", 256))


@query(rf"""WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{D_TOKEN}')) AS t FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{D_TOKEN}')) AS t FROM documents),
        r AS (SELECT t FROM b GROUP BY t HAVING count(*) = 1)
        SELECT b.item_id, count(*) AS mentions, count(DISTINCT d.doc_id) AS docs FROM b JOIN r USING (t) JOIN d USING (t) WHERE length(t) >= 8 GROUP BY b.item_id""")
def q16_identifier_overlap(spark, sf_dir):
    docs, items = docs_and_items(spark, sf_dir)
    words = lambda df, id: df.select(id, F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("t")).where(F.length("t") >= 8)
    b = words(items, "item_id")
    rare = b.groupBy("t").count().where("count = 1").select("t")
    return b.join(rare, "t").join(words(docs, "doc_id"), "t").groupBy("item_id").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT n.n_name AS term, count(*) AS docs FROM documents d JOIN (SELECT n_name FROM nation UNION ALL SELECT 'tion' UNION ALL SELECT 'License') n ON contains(lower(d.text), lower(n.n_name)) GROUP BY n.n_name")
def q17_literal_mention(spark, sf_dir):
    # One pass over the texts holds each against all terms, however many there are.
    terms = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"))
    terms = terms.unionByName(spark.createDataFrame([("tion",), ("License",)], "term string")).withColumn("t", F.lower("term"))
    found = mentions.mentions(table(spark, sf_dir, "documents").select(F.lit(1).alias("row"), F.lower("text").alias("low")), terms, "low", "t", "row")
    return found.groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("docs")).join(terms, "t").select("term", "docs")


@query(r"""WITH h AS (SELECT page_id, unnest(['links', 'heads', 'items']) AS level, unnest([sha256(array_to_string(regexp_extract_all(html, 'href="[^"]*"'), ' ')), sha256(array_to_string(regexp_extract_all(html, '<h[1-6]'), ' ')), sha256(array_to_string(regexp_extract_all(html, '<li>'), ' '))]) AS h FROM pages)
        SELECT level, h AS digest, count(*) AS n FROM h WHERE h <> sha256('') GROUP BY level, h HAVING count(*) > 1""")
def q18_component_hash_unpivot(spark, sf_dir):
    digest = lambda p: F.sha2(F.array_join(F.regexp_extract_all("html", F.lit(p), F.lit(0)), " "), 256)
    levels = F.array(*(F.struct(F.lit(k).alias("level"), digest(p).alias("digest")) for k, p in (("links", 'href="[^"]*"'), ("heads", "<h[1-6]"), ("items", "<li>"))))
    rows = table(spark, sf_dir, "pages").select(F.inline(levels)).where(F.col("digest") != F.sha2(F.lit(""), 256))
    return rows.groupBy("level", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


RISKS = """risks AS (SELECT item_id, doc_id, 'ngram_jaccard' AS label FROM pairs WHERE jaccard >= 0.8 UNION ALL SELECT item_id, doc_id, 'ngram_containment' FROM pairs WHERE containment >= 0.95 UNION ALL SELECT item_id, doc_id, 'partial' FROM pairs WHERE containment >= 0.3 AND containment < 0.95)"""


def risks(spark, sf_dir):
    p = pairs(spark, sf_dir)
    label = F.filter(F.array(F.when(F.col("jaccard") >= 0.8, "ngram_jaccard"), F.when(F.col("containment") >= 0.95, "ngram_containment"), F.when((F.col("containment") >= 0.3) & (F.col("containment") < 0.95), "partial")), lambda x: x.isNotNull())
    return p.select("item_id", "doc_id", F.explode(label).alias("label"))


@query(D_PAIRS + f", {RISKS} SELECT item_id, doc_id, label FROM risks")
def q19_risk_rollup_union(spark, sf_dir):
    return risks(spark, sf_dir)


@query(D_PAIRS + f", {RISKS} SELECT item_id, count(*) FILTER (label = 'ngram_jaccard') AS ngram_jaccard, count(*) FILTER (label = 'ngram_containment') AS ngram_containment, count(*) FILTER (label = 'partial') AS \"partial\" FROM risks GROUP BY item_id")
def q20_per_benchmark_pivot(spark, sf_dir):
    return evaluation.fixed_domain_counts(risks(spark, sf_dir), "item_id", "label", ["ngram_jaccard", "ngram_containment", "partial"])


@query(D_PAIRS + " SELECT d.doc_id, d.source FROM documents d ANTI JOIN (SELECT DISTINCT doc_id FROM pairs WHERE jaccard >= 0.8 OR containment >= 0.95) h USING (doc_id)")
def q21_holdout_anti_join(spark, sf_dir):
    docs, items = docs_and_items(spark, sf_dir)
    hits = similarity.contaminated_pairs(docs, items).select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(hits, "doc_id", "left_anti")


@query(r"""SELECT CASE WHEN contains(u, '.') THEN split_part(u, '.', 1) WHEN regexp_extract(u, '^[A-Za-z0-9]+') <> '' THEN regexp_extract(u, '^[A-Za-z0-9]+') ELSE left(u, 32) END AS prefix, count(*) AS n
        FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS u FROM pages) GROUP BY 1 ORDER BY n DESC, prefix LIMIT 50""")
def q23_source_prefix_top50(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(text.source_prefix(F.regexp_replace("url", "^[a-z]+://", "")).alias("prefix"))
    return pages.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(50)


@query(r"""WITH f AS (SELECT page_id, concat_ws('|', len(regexp_extract_all(html, '<p')), len(regexp_extract_all(html, '<a ')), len(regexp_extract_all(html, '[0-9]+')), length(html)) AS feature_key FROM pages)
        SELECT page_id, feature_key, substr(sha1(feature_key), 1, 16) AS digest FROM f""")
def q24_feature_key(spark, sf_dir):
    c = F.col("html")
    key = F.concat_ws("|", *(text.count_of(c, p) for p in ("<p", "<a ", "[0-9]+")), F.length(c))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("feature_key")).withColumn("digest", text.short_digest(F.col("feature_key")))


@query(features.ladder_sql("p_name || ' ' || p_type", "part", "category", "p_partkey"))
def q25_category_ladder(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", features.category(name).alias("category"))


@query("""WITH m AS (SELECT conv_id, turn, role, len(string_split_regex(trim(text), '\\s+')) AS k FROM conversations), r AS (SELECT conv_id, turn, role, k, sum(k) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM m)
        SELECT conv_id, least(max(upto), 512)::BIGINT AS length, sum(CASE WHEN role = 'assistant' THEN greatest(0, least(k, 512 - (upto - k))) ELSE 0 END)::BIGINT AS supervised FROM r GROUP BY conv_id
        HAVING sum(CASE WHEN role = 'assistant' THEN greatest(0, least(k, 512 - (upto - k))) ELSE 0 END) > 0""")
def q27_sft_features(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")).alias("k"))
    r = m.withColumn("upto", F.sum("k").over(W.partitionBy("conv_id").orderBy("turn")))
    kept = F.greatest(F.lit(0), F.least(F.col("k"), 512 - (F.col("upto") - F.col("k"))))
    out = r.groupBy("conv_id").agg(F.least(F.max("upto"), F.lit(512)).cast("bigint").alias("length"), F.sum(F.when(F.col("role") == "assistant", kept).otherwise(0)).cast("bigint").alias("supervised"))
    return out.where("supervised > 0")


@query("""WITH t AS (SELECT user_id, greatest(count(*), 5) AS n, count(*) FILTER (event_type <> 'error') AS c FROM events GROUP BY user_id),
        p AS (SELECT k, avg(CASE WHEN n - c < k THEN 1.0 ELSE 1 - coalesce((SELECT product(1 - k::DOUBLE / i) FROM unnest(generate_series(n - c + 1, n)) u(i)), 1.0) END) AS v, min(n) AS least FROM t, (SELECT unnest([1, 5]) AS k) GROUP BY k)
        SELECT k::BIGINT AS k, round(v, 6) AS pass_at_k FROM p WHERE k <= least""")
def q28_pass_at_k(spark, sf_dir):
    return evaluation.pass_at_k(table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", "ok")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT user_id, round(avg(value), 6) AS trimmed FROM r WHERE k > floor(n * 0.2) AND k <= n - floor(n * 0.2) GROUP BY user_id""")
def q30_trimmed_speedup(spark, sf_dir):
    return evaluation.trimmed_means(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("trimmed", 6).alias("trimmed"))


@query("""SELECT doc_id, 'short_text' AS kind, 'error' AS severity FROM documents WHERE n_chars < 100
        UNION ALL SELECT doc_id, 'long_text', 'warning' FROM documents WHERE n_chars > 10000
        UNION ALL SELECT d.doc_id, 'unlabelled', 'info' FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL
        UNION ALL SELECT d.doc_id, 'low_quality', 'error' FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0
        UNION ALL SELECT d.doc_id, 'toxic', 'error' FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1""")
def q37_contract_findings(spark, sf_dir):
    """One scan of either table: a row's findings are an array, each as often as it holds."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.lit(True).alias("known"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(marks, "doc_id", "left")
    times = lambda rule: F.when(rule, 1).otherwise(0)
    kinds = [("short_text", "error", times(F.col("n_chars") < 100)), ("long_text", "warning", times(F.col("n_chars") > 10000)), ("unlabelled", "info", times(F.col("known").isNull())), ("low_quality", "error", F.coalesce("low", F.lit(0))), ("toxic", "error", F.coalesce("toxic", F.lit(0)))]
    found = F.flatten(F.array(*(F.array_repeat(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity")), n.cast("int")) for k, s, n in kinds)))
    return docs.select("doc_id", F.inline(found))


@query("""WITH e AS (SELECT event_id, (props->>'k')::INT AS k, event_type FROM events),
        c AS (SELECT event_id, [x for x in [CASE WHEN k % 2 = 0 THEN 'syntax' END, CASE WHEN k % 3 = 0 THEN 'type' END, CASE WHEN event_type = 'error' THEN 'runtime' END] if x is not null] AS l FROM e)
        SELECT event_id, CASE WHEN len(l) = 0 THEN 'unclassified_structured' ELSE array_to_string(l, ',') END AS classes FROM c""")
def q33_feedback_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.select("event_id", F.array_join(features.labels({"syntax": F.col("k") % 2 == 0, "type": F.col("k") % 3 == 0, "runtime": F.col("event_type") == "error"}), ",").alias("classes"))


@query("""WITH e AS (SELECT (props->>'k')::INT AS k, event_type FROM events), l AS (SELECT 'syntax' AS class FROM e WHERE k % 2 = 0 UNION ALL SELECT 'type' FROM e WHERE k % 3 = 0 UNION ALL SELECT 'runtime' FROM e WHERE event_type = 'error' UNION ALL SELECT 'unclassified_structured' FROM e WHERE k % 2 <> 0 AND k % 3 <> 0 AND event_type <> 'error')
        SELECT class, count(*) AS n FROM l GROUP BY class ORDER BY n DESC, class LIMIT 30""")
def q34_feedback_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    c = e.select(F.explode(features.labels({"syntax": F.col("k") % 2 == 0, "type": F.col("k") % 3 == 0, "runtime": F.col("event_type") == "error"})).alias("class"))
    return c.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class").limit(30)


@query(r"""WITH s AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)), f AS (SELECT doc_id, trim(w) AS w, min(p) AS p FROM s WHERE trim(w) <> '' GROUP BY doc_id, trim(w)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f)
        SELECT doc_id, string_agg(w, '|' ORDER BY p) AS items FROM r WHERE k <= 10 GROUP BY doc_id""")
def q35_map_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.clean_items(F.split("text", " "), 10), "|").alias("items")).where("items <> ''")


@query(rf"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{D_TOKEN}')) AS t FROM benchmark), c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{D_TOKEN}')) AS t FROM documents)
        SELECT (SELECT count(*) FROM d) AS raw_names, (SELECT count(*) FROM c) AS names, (SELECT count(*) FROM (SELECT t FROM d EXCEPT SELECT t FROM c)) AS removed""")
def q42_name_difference(spark, sf_dir):
    docs, items = docs_and_items(spark, sf_dir)
    names = lambda df: df.select(F.explode(text.tokens(F.col("text"))).alias("t")).distinct()
    d, c = names(items), names(docs)
    tagged = d.select("t", F.lit(1).alias("d"), F.lit(0).alias("c")).unionByName(c.select("t", F.lit(0).alias("d"), F.lit(1).alias("c"))).groupBy("t").agg(F.max("d").alias("d"), F.max("c").alias("c"))
    return tagged.agg(F.sum("d").cast("bigint").alias("raw_names"), F.sum("c").cast("bigint").alias("names"), F.count_if((F.col("d") == 1) & (F.col("c") == 0)).alias("removed"))


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS "O", count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'X') AS "X" FROM lineitem GROUP BY l_returnflag""")
def q43_fixed_domain_counts(spark, sf_dir):
    return evaluation.fixed_domain_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F", "X"])


D_ORDERS = "o AS (SELECT o_orderkey AS id, o_custkey AS k, year(o_orderdate) * 400 + month(o_orderdate) * 32 + day(o_orderdate) AS b, year(o_orderdate) * 400 + month(o_orderdate) * 32 + day(o_orderdate) + floor(o_totalprice / 1000)::BIGINT AS e FROM orders)"


def intervals(spark, sf_dir):
    """Orders as intervals (id, key, begin, end) of days."""
    day = F.year("o_orderdate") * 400 + F.month("o_orderdate") * 32 + F.day("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), day.cast("bigint").alias("b"), (day + F.floor(F.col("o_totalprice") / 1000)).cast("bigint").alias("e"))


@query(f"WITH {D_ORDERS} SELECT i.id, count(p.id) AS depth FROM o i LEFT JOIN o p ON i.k = p.k AND p.b <= i.b AND i.e <= p.e AND p.e - p.b > i.e - i.b GROUP BY i.id")
def q44_interval_containment_depth(spark, sf_dir):
    items = intervals(spark, sf_dir)
    found = ordering.enclosing(items, "k", "b", "e", "id", 512).groupBy("id").agg(F.count(F.lit(1)).alias("depth"))
    return items.select("id").join(found, "id", "left").select("id", F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"))


@query(f"""WITH {D_ORDERS}, p AS (SELECT i.id, p.id AS parent, row_number() OVER (PARTITION BY i.id ORDER BY p.e - p.b, p.id) AS r FROM o i JOIN o p ON i.k = p.k AND p.b <= i.b AND i.e <= p.e AND p.e - p.b > i.e - i.b)
        SELECT id, parent FROM p WHERE r = 1""")
def q45_immediate_parent(spark, sf_dir):
    found = ordering.enclosing(intervals(spark, sf_dir), "k", "b", "e", "id", 512)
    return found.groupBy("id").agg(F.min(F.struct("width", "parent")).alias("p")).select("id", F.col("p.parent").alias("parent"))


@query("""SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND (p.ts, p.event_id) < (e.ts, e.event_id)) AS seed FROM events e WHERE event_type = 'purchase'""")
def q46_asof_seed(spark, sf_dir):
    e = ordering.previous_match(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id"), "seed")
    return e.where("event_type = 'purchase'").select("event_id", "seed")


@query("""WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS island FROM l)
        SELECT user_id, island::BIGINT AS island, event_type, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, island, event_type""")
def q47_segments(spark, sf_dir):
    s = ordering.islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return s.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_id, sum(value::DECIMAL(18, 4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def q48_running_output(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.sum(F.col("value").cast("decimal(18,4)")).over(w).alias("running"))


@query("""WITH r AS (SELECT user_id, event_id, ts, sum(value::DECIMAL(18, 4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r WHERE running > 500)
        SELECT user_id, event_id, running FROM c WHERE k = 1""")
def q49_prefix_threshold(spark, sf_dir):
    return ordering.first_crossing(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value").cast("decimal(18,4)"), 500).select("user_id", "event_id", "running")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // (((SELECT count(*) FROM orders) + 6) // 7))::BIGINT AS shard FROM orders")
def q55_contiguous_shards(spark, sf_dir):
    return ordering.contiguous_shards(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("""SELECT c_custkey, try_cast(split_part(c_name, '#', 2) AS BIGINT) AS suffix FROM customer ORDER BY suffix NULLS LAST, c_custkey""")
def q56_numeric_suffix_sort(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("bigint").alias("suffix"))
    return c.orderBy(F.asc_nulls_last("suffix"), "c_custkey")


@query("""WITH b AS (SELECT label, arg_min(embedding, vec_id) AS base FROM embeddings GROUP BY label),
        x AS (SELECT vec_id, unnest(embedding) AS v, unnest(base) AS w FROM embeddings JOIN b USING (label))
        SELECT vec_id, bool_and(abs(v - w) <= 0.6::FLOAT + 0.1::FLOAT * abs(w)) AS "close" FROM x GROUP BY vec_id""")
def q57_allclose(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    near = F.forall(F.zip_with("embedding", "base", lambda x, y: F.abs(x - y) <= F.lit(0.6).cast("float") + F.lit(0.1).cast("float") * F.abs(y)), lambda ok: ok)
    return e.join(first, "label").select("vec_id", near.alias("close"))


@query(r"""WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages WHERE contains(url, '?'))
        SELECT page_id, split_part(p, '=', 1) AS name, split_part(p, '=', 2) AS value FROM q""")
def q58_signature_params(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where(F.contains("url", F.lit("?")))
    params = F.transform(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), F.split_part(p, F.lit("="), F.lit(2)).alias("value")))
    return pages.select("page_id", F.inline(params))
