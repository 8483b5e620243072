"""Queries of source code, evaluation records and similarity matches.

The tables hold no code, so snippets are built from `part`: one function each,
with comments, literals, loops, calls and parameters that depend on the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.functions import code, features, regions, syntax, text
from corvid.operators import similarity
from corvid.plans.catalog import D_H, d_shingles, docs_and_items
from corvid.plans.registry import query
from corvid.sources.tables import spread, table

#: The snippet of a row of part, in SQL that Spark and DuckDB share.
SNIPPET = """'#include <arm_sve.h>' || chr(10) || '/* ' || p_name || ' "" */' || chr(10)
    || CASE WHEN p_size % 4 = 0 THEN 'static inline void ' WHEN p_size % 4 = 1 THEN 'std::vector<float> ' ELSE 'unsigned long ' END
    || CASE WHEN p_size % 5 = 0 THEN 'solve' ELSE 'fn' || cast(p_partkey AS string) END
    || '(const float *__restrict a, int32_t n' || CASE WHEN p_size % 3 = 0 THEN ', std::pair<int, double> &q, char' ELSE '' END || ') {' || chr(10)
    || '  for (int i = 0; i < ' || cast(p_size AS string) || '; ++i) { // ' || p_type || chr(10)
    || '    s += a[2 * i + ' || cast(p_partkey % 7 AS string) || '] * 1.5; b[i] <<= sqrtf(' || chr(39) || 'x' || chr(39) || ', "// ' || p_brand || '"); r->v = svld' || cast(p_size % 4 AS string) || '_gather_s32(p, c ? 1 : 2) % 3;' || chr(10)
    || '  }' || CASE WHEN p_size % 6 = 0 THEN ' while (k >> 1) { __asm__(1); }' ELSE '' END || chr(10) || '  return s;' || chr(10) || '}'"""

q = lambda s: s.replace("'", "''")
among = lambda *words: "(" + ", ".join(f"'{w}'" for w in words) + ")"

D_CODE = f"WITH code AS (SELECT p_partkey AS id, p_size, {SNIPPET} AS code FROM part)"
d_lex = lambda c: f"[CASE WHEN t[1] = '\"' THEN 'STR' WHEN t[1] = '''' THEN 'CHR' ELSE t END for t in regexp_extract_all({c}, '{q(code.LEXEME)}') if NOT (starts_with(t, '/*') OR starts_with(t, '//'))]"
D_TOKS = f"{D_CODE}, toks AS (SELECT id, code, {d_lex('code')} AS l FROM code)"
d_name = lambda t: f"regexp_full_match({t}, '{code.NAME}') AND {t} NOT IN {among(*code.TYPES, *code.CONTROL)}"


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).selectExpr("p_partkey AS id", "p_size", f"{SNIPPET} AS code")


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, l): the tokens of every snippet, worked out once."""
    return text.barrier(snippets(spark, sf_dir).select("id", code.code_tokens(F.col("code")).alias("l")), "l")


@query(f"{D_TOKS} SELECT id, array_to_string(l, ' ') AS tokens, sha256(lower(array_to_string(l, ' '))) AS exact_sha, len(l) AS n FROM toks")
def q70_code_tokens(spark, sf_dir):
    t = token_rows(spark, sf_dir)
    return t.select("id", F.array_join("l", " ").alias("tokens"), F.sha2(code.canonical_code(F.col("l")), 256).alias("exact_sha"), F.size("l").cast("bigint").alias("n"))


@query(f"""{D_TOKS}, p AS (SELECT id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM toks), w AS (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY k) AS u FROM p),
        m AS (SELECT id, k, CASE WHEN regexp_matches(t, '{code.NUMBER}') THEN 'NUM' WHEN {d_name('t')} THEN 'ID' ELSE lower(t) END AS a,
          CASE WHEN regexp_matches(t, '{code.NUMBER}') THEN 'NUM' WHEN {d_name('t')} THEN CASE WHEN u = '(' THEN 'CALL' ELSE 'ID' END ELSE lower(t) END AS b FROM w)
        SELECT id, string_agg(a, ' ' ORDER BY k) AS normalized, string_agg(b, ' ' ORDER BY k) AS with_calls FROM m GROUP BY id""")
def q71_normalized_tokens(spark, sf_dir):
    t = token_rows(spark, sf_dir)
    return t.select("id", F.array_join(code.normalized(F.col("l")), " ").alias("normalized"), F.array_join(code.normalized(F.col("l"), calls=True), " ").alias("with_calls"))


D_SIG = r"trim(regexp_replace(regexp_extract(code, '(?:^|\n)\s*([A-Za-z_][\w:<>,\s*&]*?\s+[A-Za-z_]\w*\s*\([^;{}]*\))\s*\{', 1), '\s+', ' ', 'g'))"
D_PARAMS = "[trim(p) for p in string_split(replace(regexp_extract(s, '(?s)\\((.*)\\)', 1), 'int, double', 'int' || chr(1) || ' double'), ',') if trim(p) NOT IN ('', 'void')]"
D_TYPED = f"{among(*code.TYPES, 'const')}"


@query(f"""{D_CODE}, g AS (SELECT id, {D_SIG} AS s FROM code), p AS (SELECT id, s, {D_PARAMS} AS l FROM g), u AS (SELECT id, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM p),
        h AS (SELECT id, k, {d_lex("replace(p, chr(1), ',')")} AS t FROM u),
        m AS (SELECT id, string_agg(array_to_string(list_concat([x for x in t if x IN {D_TYPED}], [CASE WHEN list_contains(t, '*') OR list_contains(t, '&') THEN 'ptr' ELSE 'scalar' END]), ' '), '|' ORDER BY k) AS shape, count(*) AS arity FROM h GROUP BY id)
        SELECT g.id, g.s AS signature, m.shape, m.arity, array_to_string([x for x in {d_lex("split_part(g.s, '(', 1)")} if x IN {among(*code.TYPES)}], ' ') AS returns FROM g JOIN m USING (id)""")
def q72_signature_shape(spark, sf_dir):
    s = text.barrier(snippets(spark, sf_dir).select("id", code.signature(F.col("code")).alias("signature")), "signature")
    c = F.col("signature")
    return s.select("id", "signature", code.type_shape(c).alias("shape"), F.size(code.parameters(c)).cast("bigint").alias("arity"), code.return_types(c).alias("returns"))


D_CONTROL = among(*code.CONTROL)


@query(rf"""{D_CODE}, n AS (SELECT DISTINCT id, unnest(regexp_extract_all(code, '([A-Za-z_]\w*)\s*\([^;{{}}()]*\)\s*\{{', 1)) AS name FROM code)
        SELECT name, count(*) AS rows, name IN {among(*code.GENERIC)} AS generic FROM n WHERE name NOT IN {D_CONTROL} GROUP BY name""")
def q73_function_names(spark, sf_dir):
    found = text.barrier(snippets(spark, sf_dir).select(code.function_names(F.col("code")).alias("l")), "l")
    names = found.select(F.explode("l").alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("rows")).withColumn("generic", F.col("name").isin(*code.GENERIC))


#: An intrinsic's name for each row of part: every needle of the ladder, some in pairs, and one that none fits.
NEEDLES = [n for n, _ in features.INTRINSICS] + ["zzz"]
NAMED = "'sv' || element_at(array({0}), cast(p_partkey % {1} AS int) + 1) || CASE WHEN p_size % 3 = 0 THEN '_' || element_at(array({0}), cast(p_size % {1} AS int) + 1) ELSE '_x' END".format(", ".join(f"'{n}'" for n in NEEDLES), len(NEEDLES))
D_NAMED = "'sv' || [{0}][(p_partkey % {1})::INT + 1] || CASE WHEN p_size % 3 = 0 THEN '_' || [{0}][(p_size % {1})::INT + 1] ELSE '_x' END".format(", ".join(f"'{n}'" for n in NEEDLES), len(NEEDLES))


@query(f"SELECT p_partkey, {D_NAMED} AS name, CASE " + " ".join(f"WHEN contains({D_NAMED}, '{n}') THEN '{c}'" for n, c in features.INTRINSICS) + " ELSE 'other_sv' END AS category FROM part")
def q74_intrinsic_category(spark, sf_dir):
    named = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{NAMED} AS name")
    return named.withColumn("category", features.category(F.col("name"), features.INTRINSICS, "other_sv"))


KEYS = [k for keys in features.DIAGNOSTICS.values() for k in keys]
D_DIAG = f"list_distinct([[{', '.join(repr(k) for k in KEYS)}][(event_id * m % {len(KEYS) + 4})::INT + 1] for m in [1, 5, 11]])"


@query(f"""WITH e AS (SELECT event_id, {D_DIAG} AS d FROM events), c AS (SELECT event_id, [x for x in [{', '.join("CASE WHEN " + " OR ".join(f"list_contains(d, '{k}')" for k in keys) + f" THEN '{c}' END" for c, keys in features.DIAGNOSTICS.items())}] if x IS NOT NULL] AS l FROM e)
        SELECT event_id, CASE WHEN len(l) = 0 THEN 'unclassified_structured' ELSE array_to_string(l, ',') END AS classes FROM c""")
def q75_diagnostic_classes(spark, sf_dir):
    """Each event has lists under up to three diagnostic keys, an empty one under another, and some none."""
    keys = F.array(*(F.lit(k) for k in KEYS))
    picked = F.array_distinct(F.filter(F.transform(F.array(*(F.lit(m) for m in (1, 5, 11))), lambda m: F.get(keys, (F.col("event_id") * m % (len(KEYS) + 4)).cast("int"))), lambda k: k.isNotNull()))
    lists = F.map_from_arrays("k", F.transform("k", lambda k: F.array(k)))
    events = table(spark, sf_dir, "events").select("event_id", picked.alias("k"))
    return events.select("event_id", F.array_join(features.diagnostic_classes(lists), ",").alias("classes"))


@query(rf"""{D_CODE} SELECT id, len(regexp_extract_all(code, '\bfor\s*\(')) AS fors, len(regexp_extract_all(code, '\bwhile\s*\(')) AS whiles, len(regexp_extract_all(code, '\[[^\]]+\]')) AS subscripts, len(regexp_extract_all(code, '<<|>>')) AS shifts,
        length(code) - length(replace(code, '?', '')) AS ternaries, contains(code, 'std::vector') AS has_vector, regexp_matches(code, '(^|[^A-Za-z0-9_])_{{0,2}}asm_{{0,2}}($|[^A-Za-z0-9_])') AS has_asm,
        array_to_string(list_sort([x for x in [CASE WHEN regexp_matches(code, '\[[^\[\]]*[*+][^\[\]]*\]') THEN 'affine_index' END, CASE WHEN contains(code, '.') OR contains(code, '->') THEN 'aos_or_struct' END, CASE WHEN contains(code, 'gather') THEN 'gather' END,
          CASE WHEN contains(code, 'svld2') OR regexp_matches(code, '\b2\s*\*') THEN 'interleaved_or_pair' END, CASE WHEN contains(code, 'svld3') THEN 'tuple_channel' END] if x IS NOT NULL]), ',') AS layout FROM code""")
def q76_structural_features(spark, sf_dir):
    c = F.col("code")
    counts = {"fors": r"\bfor\s*\(", "whiles": r"\bwhile\s*\(", "subscripts": r"\[[^\]]+\]", "shifts": "<<|>>", "ternaries": r"\?"}
    return snippets(spark, sf_dir).select("id", *(text.count_of(c, p).alias(k) for k, p in counts.items()), F.contains(c, F.lit("std::vector")).alias("has_vector"), code.has_inline_asm(c).alias("has_asm"), F.array_join(code.layout_classes(c), ",").alias("layout"))


@query(rf"""{D_TOKS}, s AS (SELECT id, list_sort([array_to_string([CASE WHEN regexp_matches(t, '{code.NUMBER}') THEN 'NUM' WHEN {d_name('t')} THEN 'ID' ELSE lower(t) END for t in {d_lex('x')}], ' ') for x in regexp_extract_all(code, '[A-Za-z_]\w*\s*\[([^\[\]]+)\]', 1)]) AS a,
          list_sort([t for t in l if t IN {among(*code.ASSIGN)}]) AS b FROM toks),
        p AS (SELECT id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM toks), w AS (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY k) AS u FROM p),
        c AS (SELECT id, CASE WHEN starts_with(t, 'sv') THEN 'sve:' || regexp_replace(t, '_[suf](?:8|16|32|64).*$', '_T') WHEN t IN {among(*code.MATH)} THEN 'math:' || rtrim(t, 'f') ELSE 'call' END AS c FROM w WHERE u = '(' AND regexp_full_match(t, '[A-Za-z_]\w*') AND t NOT IN {among(*code.CONTROL, *code.TYPES)})
        SELECT s.id, array_to_string(a, '|') AS array_shapes, array_to_string(b, '|') AS assignments, (SELECT string_agg(c, '|' ORDER BY c) FROM c WHERE c.id = s.id) AS calls FROM s""")
def q77_semantic_features(spark, sf_dir):
    rows = text.barrier(snippets(spark, sf_dir).select("id", "code", code.code_tokens(F.col("code")).alias("l")), "l")
    return rows.select("id", F.array_join(code.array_shapes(F.col("code")), "|").alias("array_shapes"), F.array_join(code.assignments(F.col("l")), "|").alias("assignments"), F.array_join(code.called(F.col("l")), "|").alias("calls"))


@query("""SELECT event_type, count(*) FILTER (f) AS failures, count(*) AS n, round_even(count(*) FILTER (f) * 100.0 / count(*), 2)::DOUBLE AS percent FROM (SELECT event_type,
          NOT (coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN '1' WHEN event_id % 3 = 1 THEN 'x' ELSE '0' END AS INT), 0) <> 0) OR contains(lower(event_type), 'compile') OR trim(CASE WHEN event_id % 5 = 0 THEN 'log' ELSE '  ' END) <> '' AS f FROM events) GROUP BY event_type""")
def q78_compile_failures(spark, sf_dir):
    id = F.col("event_id")
    failed = features.is_compile_failure(F.when(id % 3 == 0, "1").when(id % 3 == 1, "x").otherwise("0"), F.col("event_type"), F.when(id % 5 == 0, "log").otherwise("  "))
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(failed).alias("failures"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("percent", F.bround(F.col("failures") * 100 / F.col("n"), 2))


D_SIGS = f"""WITH {d_shingles('a', 'documents', 'doc_id', 1)}, {d_shingles('b', 'benchmark', 'item_id', 1)}"""


def signatures(make, spark, sf_dir, *more) -> tuple[DataFrame, DataFrame]:
    """One signature row for each document and for each item."""
    docs, items = docs_and_items(spark, sf_dir)
    return make(similarity.shingle_rows(docs, "doc_id"), "doc_id", *more), make(similarity.shingle_rows(items, "item_id"), "item_id", *more)


#: Each slot's least value of the one hash of a shingle; the factors are those of similarity.slot_factors.
MINS = [f"min(({D_H.format('s')} % {similarity.PRIME} * {a} + {b}) % {similarity.PRIME})" for a, b in similarity.slot_factors(16)]
#: Each slot's least value of hashes of its own.
SLOTS = ", ".join("min({}) AS m{}".format(D_H.format(f"'{k}:' || s"), k) for k in range(16))


@query(f"{D_SIGS} SELECT 'core' AS dataset, doc_id AS id, {SLOTS} FROM a_d GROUP BY doc_id UNION ALL SELECT 'bench', item_id, {SLOTS} FROM b_d GROUP BY item_id")
def q08_minhash_portable(spark, sf_dir):
    parts = [df.select(F.lit(name).alias("dataset"), F.col(df.columns[0]).alias("id"), *(F.col("sig")[k].alias(f"m{k}") for k in range(16))) for name, df in zip(("core", "bench"), signatures(similarity.portable_slots, spark, sf_dir, 16), strict=True)]
    return parts[0].unionByName(parts[1])


LIST = ", ".join(MINS)


@query(f"""{D_SIGS}, x AS (SELECT doc_id, [{LIST}] AS s FROM a_d GROUP BY doc_id), y AS (SELECT item_id, [{LIST}] AS s FROM b_d GROUP BY item_id),
        p AS (SELECT doc_id, item_id, len([z for z in list_zip(x.s, y.s) if z[1] = z[2]]) / 16.0 AS agreement FROM x, y)
        SELECT doc_id, item_id, round(agreement, 6)::DOUBLE AS agreement FROM p WHERE agreement >= 0.84""")
def q69_minhash_match(spark, sf_dir):
    docs, items = signatures(similarity.portable_minhash, spark, sf_dir, 16)
    return similarity.minhash_matches(docs, items, "doc_id", "item_id", 16, 0.84).withColumn("agreement", F.round("agreement", 6))


BITS = " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {k}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << k}::BIGINT ELSE 0::BIGINT END" for k in range(60))


@query(f"""{D_SIGS}, x AS (SELECT doc_id, count(*) AS n, {BITS} AS sim FROM (SELECT doc_id, {D_H.format('s')} AS h FROM a_d) GROUP BY doc_id), y AS (SELECT item_id, count(*) AS n, {BITS} AS sim FROM (SELECT item_id, {D_H.format('s')} AS h FROM b_d) GROUP BY item_id)
        SELECT doc_id, item_id, bit_count(xor(x.sim, y.sim))::BIGINT AS hamming FROM x, y WHERE bit_count(xor(x.sim, y.sim)) <= 4 AND greatest(x.n, y.n) >= 20""")
def q10_simhash_hamming(spark, sf_dir):
    docs, items = signatures(similarity.portable_simhash, spark, sf_dir)
    return similarity.simhash_matches(docs, items, "doc_id", "item_id")


#: What a page is made of: equal for pages of one template.
D_KEY = "concat_ws('|', len(regexp_extract_all(html, '<p')) > 0, len(regexp_extract_all(html, '<li')) > 0, len(regexp_extract_all(html, '<h[1-6]')) > 0, html LIKE '%<table%')"


@query(f"""WITH k AS (SELECT page_id, html AS text, {D_KEY} AS key FROM pages), c AS (SELECT page_id AS core_id, text FROM k WHERE page_id % 10 <> 0), b AS (SELECT page_id AS bench_id, text FROM k WHERE page_id % 10 = 0),
        {d_shingles('x', 'c', 'core_id', 1)}, {d_shingles('y', 'b', 'bench_id', 1)},
        p AS (SELECT core_id, bench_id, count(*) / (nx.n + ny.n - count(*)) AS jaccard, count(*) / least(nx.n, ny.n) AS containment FROM x_d JOIN y_d USING (s) JOIN x_n nx USING (core_id) JOIN y_n ny USING (bench_id) GROUP BY core_id, bench_id, nx.n, ny.n)
        SELECT core_id, bench_id, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM p JOIN k i ON i.page_id = core_id JOIN k j ON j.page_id = bench_id WHERE i.key = j.key AND (jaccard >= 0.45 OR containment >= 0.75)""")
def q15_semantic_high_risk(spark, sf_dir):
    """Pairs of equal structure whose shingles overlap by 0.45, or hold 0.75 of the smaller set; every tenth page stands for the benchmark."""
    c = F.col("html")
    key = F.concat_ws("|", *((text.count_of(c, p) > 0).cast("string") for p in ("<p", "<li", "<h[1-6]", "<table")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), key.alias("key"))
    core, bench = pages.where("page_id % 10 <> 0").withColumnRenamed("page_id", "core_id"), pages.where("page_id % 10 = 0").withColumnRenamed("page_id", "bench_id")
    hits = similarity.semantic_matches(core, bench, "core_id", "bench_id", "key")
    return hits.select("core_id", "bench_id", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"))


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS b FROM conversations)
        SELECT conv_id, 'final' AS label, turn FROM r WHERE z = 1 AND role = 'assistant' UNION ALL SELECT conv_id, 'best', turn FROM r WHERE b = 1 UNION ALL SELECT conv_id, 'last', turn FROM r WHERE z = 1 UNION ALL SELECT conv_id, 'history[' || (k - 1) || '].result', turn FROM r WHERE role <> 'system'""")
def q79_result_locations(spark, sf_dir):
    """All results of a record, each with the place where it stands; places without one are left out."""
    w = W.partitionBy("conv_id")
    r = table(spark, sf_dir, "conversations").withColumns({"k": F.row_number().over(w.orderBy("turn")), "z": F.row_number().over(w.orderBy(F.desc("turn"))), "b": F.row_number().over(w.orderBy(F.length("text").desc(), "turn"))})
    places = [("final", (F.col("z") == 1) & (F.col("role") == "assistant")), ("best", F.col("b") == 1), ("last", F.col("z") == 1)]
    found = F.array(*(F.when(rule, F.lit(name)) for name, rule in places), F.when(F.col("role") != "system", F.concat(F.lit("history["), F.col("k") - 1, F.lit("].result"))))
    return r.select("conv_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("label"), "turn")


def flag_columns(names, share: int, salt: int = 0) -> str:
    """SQL of boolean columns that hold for about share / 11 of the events, each in its own way."""
    return ", ".join(f"(event_id * event_id % 1009 * {k + 2 + salt} + event_id * {k + 1}) % 11 < {share} AS {n}" for k, n in enumerate(names))


OPS = "CASE WHEN event_id % 3 = 0 THEN '=' ELSE '+=' END AS op"
SOME_KINDS = ("prefix_scan_predicate", "arg_reduction", "bounded_predicate_scan", "conflict_update", "dependency_or_inplace_update", "nested_reduction_update", "array_update", "two_pointer_swap", "hybrid_elementwise_store", "pseudocode_loop")
KINDS = "CASE " + " ".join(f"WHEN event_id % 23 = {k} THEN '{n}'" for k, n in enumerate(SOME_KINDS)) + " ELSE 'store_map' END AS kind"


@query(f"SELECT event_id, {regions.ladder_case(regions.REGIONS, 'pseudocode_loop')} AS kind FROM (SELECT event_id, {flag_columns(regions.REGION_FLAGS, 3)} FROM events)")
def q99_region_kinds(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", *flag_columns(regions.REGION_FLAGS, 3).split(", ")).select("event_id", regions.region_kind().alias("kind"))


@query(f"SELECT event_id, kind, {regions.RENDERED} AS vector FROM (SELECT event_id, {KINDS}, {flag_columns(regions.RENDER_FLAGS, 2)} FROM events)")
def q100_vector_regions(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", KINDS, *flag_columns(regions.RENDER_FLAGS, 2).split(", ")).select("event_id", "kind", regions.runs_as_vector().alias("vector"))


@query(f"SELECT event_id, {regions.ladder_case(regions.LABELS, 'compute')} AS label FROM (SELECT event_id, {KINDS}, {OPS}, {flag_columns(regions.LABEL_FLAGS, 3)} FROM events)")
def q101_item_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", KINDS, OPS, *flag_columns(regions.LABEL_FLAGS, 3).split(", ")).select("event_id", regions.item_label().alias("label"))


@query(f"""WITH r AS (SELECT event_id, {regions.ladder_case(regions.ROUTES, 'generic_code_like_pseudocode')} AS pattern FROM (SELECT event_id, {flag_columns(regions.ROUTE_FLAGS, 1)} FROM events))
        SELECT CASE WHEN pattern IN ('scalar_or_irregular_control', 'generic_code_like_pseudocode') THEN 'pseudocode' ELSE 'dataflow_pseudocode' END AS style, pattern, count(*) AS n FROM r GROUP BY pattern""")
def q102_routes(spark, sf_dir):
    """Bootstrap counters: how many functions go which way."""
    seen = table(spark, sf_dir, "events").selectExpr("event_id", *flag_columns(regions.ROUTE_FLAGS, 1).split(", ")).select(regions.route().alias("pattern"))
    return seen.groupBy(regions.route_style(F.col("pattern")).alias("style"), "pattern").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT p_partkey, line, trim(line) AS t, regexp_replace(line, '"[^"]*"', ' ', 'g') AS bare FROM (SELECT p_partkey, unnest([p_name || ' +', '  ', 'a = f(b, "(" , c)', 'g((x)', 'g((x) ...', p_type || '(', p_brand || ' = 2;']) AS line FROM part))
        SELECT p_partkey, line, t = '' OR regexp_matches(t, '[-+*/&|^]$') OR (length(bare) - length(replace(bare, '(', '')) > length(bare) - length(replace(bare, ')', '')) AND NOT ends_with(t, '...')) AS malformed FROM t""")
def q103_malformed_lines(spark, sf_dir):
    lines = F.array(F.concat("p_name", F.lit(" +")), F.lit("  "), F.lit('a = f(b, "(" , c)'), F.lit("g((x)"), F.lit("g((x) ..."), F.concat("p_type", F.lit("(")), F.concat("p_brand", F.lit(" = 2;")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(lines).alias("line")).withColumn("malformed", regions.is_malformed_line(F.col("line")))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'sequential' WHEN o_orderkey % 3 = 1 THEN 'hybrid' ELSE 'pure' END AS s, o_totalprice > 200000 AS c, o_orderstatus = 'P' AS u FROM orders)
        SELECT o_orderkey, CASE WHEN u THEN 'not_suitable_for_single_function' WHEN s = 'sequential' THEN 'sequential_holdout' WHEN c THEN 'requires_context_prelude' WHEN s = 'hybrid' THEN 'hybrid_single_function' ELSE 'pure_sve_single_function' END AS category FROM o""")
def q104_primary_category(spark, sf_dir):
    key = F.col("o_orderkey")
    strategy = F.when(key % 3 == 0, "sequential").when(key % 3 == 1, "hybrid").otherwise("pure")
    return table(spark, sf_dir, "orders").select("o_orderkey", features.primary_category(strategy, F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "P").alias("category"))


@query(rf"""{D_CODE}, f AS (SELECT id, code, 'at /home/u/' || id || '/f.cpp:3: error in /mnt/x/y' || chr(10) || '```cpp' || chr(10) || code || chr(10) || '```' || chr(10) || 'end' AS t FROM code)
        SELECT id, trim(regexp_extract(t, '(?s)```[A-Za-z0-9_+-]*[ \t]*\n(.*?)```', 1), chr(10) || ' ') AS body, array_to_string([x for x in string_split(code, chr(10)) if NOT starts_with(ltrim(x), '#include')], chr(10)) AS no_includes,
          array_to_string([x for x in string_split(replace(code, ';', chr(10) || ' ' || chr(10)), chr(10)) if trim(x) <> ''], chr(10)) AS no_blanks, regexp_replace(split_part(t, chr(10), 1), '/(?:home|mnt)/(?:[^\s:/]+/)*([^\s:/]+)', '\1', 'g') AS message FROM f""")
def q105_cleaned_texts(spark, sf_dir):
    fenced = F.concat(F.lit("at /home/u/"), "id", F.lit("/f.cpp:3: error in /mnt/x/y\n```cpp\n"), "code", F.lit("\n```\nend"))
    rows = snippets(spark, sf_dir).withColumn("t", fenced)
    return rows.select("id", code.without_fences(F.col("t")).alias("body"), code.without_includes(F.col("code")).alias("no_includes"), code.without_blank_lines(F.replace(F.col("code"), F.lit(";"), F.lit("\n \n"))).alias("no_blanks"), code.hidden_paths(F.split_part("t", F.lit("\n"), F.lit(1))).alias("message"))


@query(rf"""{D_CODE}, g AS (SELECT id, {D_SIG} AS s FROM code), a AS (SELECT id, s, regexp_replace(regexp_replace(s, '\s*([(),*])\s*', '\1', 'g'), '[*]', ' * ', 'g') AS c FROM g)
        SELECT id, trim(replace(replace(replace(regexp_replace(c, '\s+', ' ', 'g'), ' ,', ','), ' )', ')'), '( ', '(')) AS signature, regexp_extract(s, '([A-Za-z_]\w*)\s*\(', 1) AS entry FROM a""")
def q106_signature_text(spark, sf_dir):
    s = text.barrier(snippets(spark, sf_dir).select("id", code.signature(F.col("code")).alias("s")), "s")
    odd = F.concat(F.lit(" extern  "), "s", F.lit(" ; "))
    return s.select("id", code.signature_text(odd).alias("signature"), code.entry_point(F.col("s")).alias("entry"))


@query(rf"""{D_CODE}, g AS (SELECT id, {D_SIG} AS s FROM code), p AS (SELECT id, s, {D_PARAMS} AS l FROM g), u AS (SELECT id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS k FROM p),
        a AS (SELECT id, k, replace(p, chr(1), ',') AS p FROM u)
        SELECT id, k::INT AS place, p AS param, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '\b(?:__restrict__|__restrict|restrict)\b', ' restrict', 'g'), '\b[A-Za-z_][A-Za-z0-9_]*\s*((?:\[[^\]]*\])?\s*)$', 'NAME\1'), '\s+', ' ', 'g'), ' ?([*&]) ?', '\1', 'g') AS type FROM a""")
def q107_parameter_types(spark, sf_dir):
    s = text.barrier(snippets(spark, sf_dir).select("id", code.signature(F.col("code")).alias("s")), "s")
    params = text.barrier(s.select("id", code.parameters(F.col("s")).alias("l")), "l")
    return params.select("id", F.posexplode("l").alias("place", "param")).withColumn("type", code.type_text(F.col("param")))


@query()
def q108_loop_depth(spark, sf_dir):
    return token_rows(spark, sf_dir).select("id", code.loop_depth(F.col("l")).alias("depth"))


#: How many items of each kind a feature bundle keeps.
CAPS = {"loops": 12, "branches": 16, "assignments": 24, "returns": 8, "controls": 16, "calls": 24, "array_subscripts": 32, "members": 16, "var_decls": 32, "read_write": 64, "same_array_dependencies": 12}
D_KIND = "CASE " + " ".join(f"WHEN l_partkey % {len(CAPS)} = {k} THEN '{n}'" for k, n in enumerate(CAPS)) + " END"
D_CAP = "CASE " + " ".join(f"WHEN l_partkey % {len(CAPS)} = {k} THEN {c}" for k, c in enumerate(CAPS.values())) + " END"


@query(f"WITH r AS (SELECT l_suppkey, {D_KIND} AS kind, {D_CAP} AS cap, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, {D_KIND} ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) SELECT l_suppkey, kind, count(*) AS kept, max(l_orderkey) AS last_kept FROM r WHERE k <= cap GROUP BY l_suppkey, kind")
def q110_capped_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", f"{D_KIND} AS kind", f"{D_CAP} AS cap", "l_orderkey", "l_linenumber")
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("l_suppkey", "kind").orderBy("l_orderkey", "l_linenumber"))).where("k <= cap")
    return ranked.groupBy("l_suppkey", "kind").agg(F.count(F.lit(1)).alias("kept"), F.max("l_orderkey").alias("last_kept"))


@query(rf"""{D_CODE}, n AS (SELECT id, unnest(regexp_extract_all(code, '([A-Za-z_]\w*)\s*\([^;{{}}()]*\)\s*\{{', 1)) AS name FROM code), t AS (SELECT DISTINCT id, name FROM n WHERE name NOT IN {D_CONTROL} AND length(name) >= 4),
        o AS (SELECT name, min(id) AS owner FROM t WHERE id % 10 = 0 GROUP BY name), w AS (SELECT DISTINCT id, unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM code WHERE id % 10 <> 0)
        SELECT o.name, o.owner, o.name IN {among(*code.GENERIC)} AS generic, count(*) AS mentions FROM o JOIN w USING (name) GROUP BY o.name, o.owner""")
def q112_name_mentions(spark, sf_dir):
    """Function names of four characters or more that every tenth snippet defines, looked for as whole words in the others; the first snippet owns a name.

    Words are counted before the join, and neither side, both of which grow with the table, is sent whole to the driver.
    """
    c = F.col("code")
    rows = snippets(spark, sf_dir)
    names = text.barrier(rows.where("id % 10 = 0").select("id", code.function_names(c).alias("l")), "l").select("id", F.explode("l").alias("name")).where(F.length("name") >= 4).groupBy("name").agg(F.min("id").alias("owner"))
    words = text.barrier(rows.where("id % 10 <> 0").select(F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("l")), "l").select(F.explode("l").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))
    return names.join(words.hint("merge"), "name").select("name", "owner", "mentions").withColumn("generic", F.col("name").isin(*code.GENERIC))


@query("""WITH d AS (SELECT p_brand AS name, p_type AS sig, min(p_partkey) AS first FROM part GROUP BY p_brand, p_type)
        SELECT name, count(*) AS overloads, string_agg(sig, ';' ORDER BY first) AS signatures FROM d GROUP BY name""")
def q113_overloads(spark, sf_dir):
    """Distinct signatures of each name, in the order in which they come first."""
    d = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("sig")).agg(F.min("p_partkey").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "sig")))
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("overloads"), F.array_join(F.transform(ordered, lambda x: x["sig"]), ";").alias("signatures"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, (props->>'k')::INT AS k FROM events), c AS (SELECT user_id, event_type, '{"event":"' || event_type || '","k":' || k || ',"user":' || user_id || '}' AS j, event_id FROM e)
        SELECT sha256(j) AS digest, count(*) AS n, min(event_id) AS first_event FROM c GROUP BY j""")
def q115_canonical_json(spark, sf_dir):
    """Rows that are the same object in canonical JSON: keys in order, no blanks."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))
    j = F.to_json(F.struct(F.col("event_type").alias("event"), "k", F.col("user_id").alias("user")))
    return e.select("event_id", j.alias("j")).groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")).select(F.sha2("j", 256).alias("digest"), "n", "first_event")


D_SV = "CASE " + " ".join(f"WHEN contains(x, '{n}') THEN '{c}'" for n, c in features.INTRINSICS) + " ELSE 'other_sv' END"


@query(rf"""{D_CODE}, f AS (SELECT id, code, len(regexp_extract_all(code, '\bfor\s*\(')) AS f, len(regexp_extract_all(code, '\bwhile\s*\(')) AS w, len(regexp_extract_all(code, '\bif\s*\(')) AS i, len(regexp_extract_all(code, '\breturn\b')) AS r, len(regexp_extract_all(code, '\[[^\]]+\]')) AS sub,
          len(regexp_extract_all(code, '\+\s*[A-Za-z_][A-Za-z0-9_]*')) AS ptr, contains(code, 'std::vector')::INT AS vec, contains(code, 'std::string')::INT AS str, length(code) - length(replace(code, '%', '')) AS mods, len(regexp_extract_all(code, '<<|>>')) AS shifts, length(code) - length(replace(code, '?', '')) AS tern,
          regexp_extract_all(code, '\bsv[a-zA-Z0-9_]*\b') AS sv FROM code),
        k AS (SELECT id, concat_ws('|', 'loop=f' || f || ':w' || w || ':if' || i || ':ret' || r, 'mem=sub' || sub || ':ptr' || ptr || ':vec' || vec || ':str' || str, 'ops=mod' || mods || ':shift' || shifts || ':tern' || tern, 'svseq=' || array_to_string([{D_SV} for x in sv], ','), 'sve=' || array_to_string(sv, ',')) AS key FROM f)
        SELECT id, key AS feature_key, substr(sha1(key), 1, 16) AS struct_hash FROM k""")
def q116_feature_key(spark, sf_dir):
    """The structural key of every snippet: loops, memory, operators and intrinsics with their kinds."""
    rows = snippets(spark, sf_dir).select("id", features.structure_key(F.col("code")).alias("feature_key"))
    return rows.withColumn("struct_hash", text.short_digest(F.col("feature_key")))


HEADER = "'for (' || CASE WHEN p_size % 2 = 0 THEN 'int ' ELSE '' END || 'i = ' || cast(p_size AS string) || '; ' || CASE WHEN p_size % 7 = 0 THEN 'k' ELSE 'i' END || CASE WHEN p_size % 3 = 0 THEN ' >= ' ELSE ' < ' END || 'n' || CASE WHEN p_size % 5 = 0 THEN ' && a[i]' WHEN p_size % 11 = 0 THEN ' || b' ELSE '' END || '; ' || CASE WHEN p_size % 4 = 0 THEN 'i++' WHEN p_size % 4 = 1 THEN 'j++, i -= 2' WHEN p_size % 4 = 2 THEN 'i = i + w' ELSE 'j--' END || ')'"


@query(rf"""WITH h AS (SELECT p_partkey, p_size AS s, {HEADER} AS header FROM part)
        SELECT p_partkey, header, 'i' AS var, regexp_extract(header, 'i = ([0-9]+);', 1) AS start, CASE WHEN s % 3 = 0 THEN '>=' ELSE '<' END AS cmp, 'n' AS "end", CASE WHEN s % 5 = 0 THEN 'a[i]' ELSE '' END AS extra,
          CASE WHEN s % 3 = 0 AND s % 4 <> 1 THEN '-' ELSE '' END || CASE s % 4 WHEN 0 THEN '1' WHEN 1 THEN '-2' ELSE 'w' END AS step
        FROM h WHERE s % 7 <> 0 AND s % 4 <> 3 AND NOT contains(header, '||')""")
def q120_loop_specs(spark, sf_dir):
    h = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{HEADER} AS header")
    found = text.barrier(h.select("p_partkey", "header", syntax.loop_spec(F.col("header")).alias("s")), "s")
    return found.where("s is not null").select("p_partkey", "header", "s.*")


DECLARED = ("const float *__restrict", "std::vector<double>", "std::vector<std::string>", "std::string &", "int [4]", "auto", "std::map<int, float>", "float16_t * *", "uint8_t", "void *")


@query("SELECT p_partkey, [" + ", ".join(f"'{d}'" for d in DECLARED) + """][(p_partkey % 10)::INT + 1] AS declared, ['float', 'double', '', 'char', 'int', '', '', 'float16_t', 'uint8_t', ''][(p_partkey % 10)::INT + 1] AS element,
        (p_partkey % 10)::INT IN (0, 7) AS floating, (p_partkey % 10)::INT IN (1, 2, 3, 6) AS container FROM part""")
def q121_declared_types(spark, sf_dir):
    kinds = F.array(*(F.lit(d) for d in DECLARED))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 10).cast("int")).alias("declared"))
    c = F.col("declared")
    return rows.select("p_partkey", "declared", syntax.element_type(c).alias("element"), syntax.is_floating(c).alias("floating"), syntax.is_container(c).alias("container"))


#: A dumped tree for each row of part: an included function, a helper, the target with a loop, a call, an operator and a variable, and main.
TREE = """'{"kind":"TranslationUnitDecl","inner":[{"kind":"FunctionDecl","name":"lib","loc":{"includedFrom":{"file":"x"}},"inner":[{"kind":"CompoundStmt"}]},'
    || CASE WHEN p_size % 2 = 0 THEN '{"kind":"FunctionDecl","name":"helper","type":{"qualType":"int ()"},"inner":[{"kind":"CompoundStmt","inner":[{"kind":"ReturnStmt"}]}]},' ELSE '' END
    || '{"kind":"FunctionDecl","name":"f' || cast(p_size AS string) || '","type":{"qualType":"void (float *)"},"inner":[{"kind":"ParmVarDecl","name":"a","type":{"qualType":"float *"}},{"kind":"CompoundStmt","inner":['
    || CASE WHEN p_size % 3 = 0 THEN '{"kind":"VarDecl","type":{"qualType":"int"}},' ELSE '' END
    || '{"kind":"ForStmt","inner":[{"kind":"BinaryOperator","opcode":"<"},{"kind":"CallExpr","inner":[{"kind":"DeclRefExpr","referencedDecl":{"kind":"FunctionDecl","name":"svadd"}}]}]}]}]},{"kind":"FunctionDecl","name":"main","inner":[{"kind":"CompoundStmt"}]}]}'"""


@query(f"""SELECT p_partkey, (2 + (p_size % 2 = 0)::INT)::BIGINT AS functions, 'f' || p_size AS target, (7 + (p_size % 3 = 0)::INT)::BIGINT AS nodes, 'ret=void (float *)|params=float *' AS signature,
        'CompoundStmt,' || CASE WHEN p_size % 3 = 0 THEN 'VarDecl:int,' ELSE '' END || 'ForStmt,BinaryOperator:<,CallExpr:CALL,DeclRefExpr:FunctionDecl' AS kinds FROM part""")
def q122_tree_features(spark, sf_dir):
    rows = text.barrier(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{TREE} AS t").select("p_partkey", syntax.tree_nodes("t").alias("n")), "n")
    found = text.barrier(rows.select("p_partkey", "n", syntax.functions_of(F.col("n")).alias("f")), "f")
    target = found.withColumn("own", syntax.target_function(F.col("f"), F.lit("absent")))
    own = F.slice(F.col("n"), F.col("own.at") + 1, F.col("own.size"))
    return target.select("p_partkey", F.size("f").cast("bigint").alias("functions"), F.col("own.name").alias("target"), F.size(own).cast("bigint").alias("nodes"), syntax.tree_signature(own).alias("signature"), syntax.kind_stream(own).alias("kinds"))


#: Snippets with function pointers, templates three deep, default values and a second function.
HARD = """'#include <map>' || chr(10) || '// fn() {' || chr(10) || 'static std::map<int, std::vector<std::pair<int, float>>> pick' || cast(p_partkey % 5 AS string) || '(int a' || CASE WHEN p_size % 2 = 0 THEN ', int (*cb)(int, float (*)(int))' ELSE '' END
    || CASE WHEN p_size % 3 = 0 THEN ', std::map<int, std::vector<std::pair<int, int>>> &m' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ', int d = g(1, h(2, 3))' ELSE '' END || ') {' || chr(10) || '  for (int i = 0; i < n; ++i) { }' || chr(10) || '}' || chr(10)
    || CASE WHEN p_partkey % 2 = 0 THEN 'unsigned long  last' || cast(p_partkey % 3 AS string) || ' (float *x, const char *(*f)(void))' || chr(10) || '{ }' ELSE '' END"""
NESTED = r"\((?:[^(){};]|\((?:[^(){};]|\([^(){};]*\))*\))*\)"


@query(rf"""WITH c AS (SELECT p_partkey AS id, {HARD} AS code FROM part), h AS (SELECT id, code, regexp_extract_all(code, '(?:^|\n)\s*([A-Za-z_][\w:<>,\s*&]*?\s+[A-Za-z_]\w*\s*{NESTED})\s*\{{', 1) AS heads FROM c),
        p AS (SELECT id, unnest(regexp_extract_all(regexp_extract(heads[1], '(?s)\((.*)\)', 1), '[^(),<>]+|[(),<>]')) AS t, generate_subscripts(regexp_extract_all(regexp_extract(heads[1], '(?s)\((.*)\)', 1), '[^(),<>]+|[(),<>]'), 1) AS k FROM h),
        d AS (SELECT *, sum(CASE WHEN t IN ('(', '<') THEN 1 WHEN t IN (')', '>') THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS depth FROM p),
        n AS (SELECT *, t = ',' AND depth = 0 AS cut, sum(CASE WHEN t = ',' AND depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS part FROM d),
        q AS (SELECT id, part, trim(string_agg(t, '' ORDER BY k)) AS param FROM n WHERE NOT cut GROUP BY id, part)
        SELECT id, array_to_string(list_sort(list_distinct([x for x in regexp_extract_all(code, '([A-Za-z_]\w*)\s*{NESTED}\s*\{{', 1) if x NOT IN {D_CONTROL} AND NOT contains(x, 'fn')])), ',') AS names, trim(regexp_replace(heads[-1], '\s+', ' ', 'g')) AS last_signature,
          (SELECT string_agg(param, ';' ORDER BY part) FROM q WHERE q.id = h.id) AS params FROM h""")
def q133_function_heads(spark, sf_dir):
    """Names, the last signature and the first one's parameters of code with brackets in brackets; a function in a comment is none."""
    rows = spread(table(spark, sf_dir, "part")).selectExpr("p_partkey AS id", f"{HARD} AS code")
    heads = text.barrier(rows.select("id", code.function_heads(F.col("code")).alias("h")), "h")
    whole = F.filter(F.transform("h", lambda x: x["head"]), lambda x: x.isNotNull())
    return heads.select("id", F.array_join(F.array_sort(F.array_distinct(F.transform("h", lambda x: x["name"]))), ",").alias("names"), F.try_element_at(whole, F.lit(-1)).alias("last_signature"), F.array_join(code.parameters(F.get(whole, 0)), ";").alias("params"))
