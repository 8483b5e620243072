"""Queries of task rows and their code: contract findings, name matches, signature keys, running numbers.

Tasks are put together from `part`: the numbers of a row decide which of its fields break the contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import code, features, prompts, text
from corvid.operators import contracts, ordering
from corvid.plans.code_catalog import D_CONTROL, HARD, NESTED, among
from corvid.plans.registry import query
from corvid.sources.tables import spread, table

K = "p_partkey"
REQUIRED = ["#include", "int main", "```"]
HELPERS = {"math_helpers": ["helper_exp", "helper_log"], "morph_helpers": ["helper_row"]}
SIG = "'void f' || cast(p_partkey % 20 AS string) || '(float *a, int n)'"
FIELDS = [
    f"{K} AS id", f"'b' || cast({K} % 4 AS string) AS benchmark", f"CASE WHEN {K} % 23 = 0 THEN '' ELSE {SIG} END AS signature",
    f"'/* ' || p_name || CASE WHEN {K} % 13 = 0 THEN ' use svbad_f32' ELSE '' END || ' */' || chr(10) || CASE WHEN {K} % 7 = 0 THEN 'void g()' ELSE {SIG} END || CASE WHEN {K} % 5 = 0 THEN ' {{ return; }}' ELSE ' {{' || chr(10) || '}}' || chr(10) || ' ' END AS prompt",
    f"CASE WHEN {K} % 6 = 0 THEN 'float helper_exp(float x) {{ return x; }}' WHEN {K} % 6 = 1 THEN 'static int odd(int (*f)(int)) {{ }}' WHEN {K} % 6 = 2 THEN '#define N 3' ELSE '' END AS prelude",
    f"{K} % 9 <> 0 AS must_match", f"CASE WHEN {K} % 8 = 0 THEN '```' WHEN {K} % 8 = 1 THEN '' ELSE 'int main;#include;```;more' END AS forbidden",
    f"CASE WHEN {K} % 11 = 0 THEN 'extern void  f' || cast({K} % 20 AS string) || '( float * a,int n );' WHEN {K} % 11 = 1 THEN 'extern void other(int n);' ELSE '' END AS extern", f"CASE WHEN {K} % 10 = 3 THEN 'int parent(int n)' WHEN {K} % 10 = 4 THEN {SIG} ELSE '' END AS parent",
    f"CASE WHEN {K} % 3 = 0 THEN true WHEN {K} % 3 = 1 THEN {K} % 2 = 0 END AS smoke_ok", f"{K} % 12 < 6 AS math_helpers", f"{K} % 2 = 0 AS morph_helpers",
]


def tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tasks and their findings."""
    rows = table(spark, sf_dir, "part").selectExpr(*FIELDS)
    forbidden = F.filter(F.split("forbidden", ";"), lambda t: t != "")
    rows = rows.withColumn("contract", F.struct(F.col("must_match").alias("signature_must_match_prompt"), forbidden.alias("forbidden"))).withColumn("smoke_message", F.lit("no compiler here"))
    return rows, contracts.contract_findings(rows, "id", REQUIRED, r"\bsvbad_\w+", HELPERS, F.col("benchmark") == "b0")


# What the numbers of a row say about it, without a look at its texts.
D_FOUND = f"""found AS (SELECT {K} AS id, 'signature_missing_from_prompt' AS kind, '' AS detail FROM part WHERE {K} % 7 = 0 OR {K} % 23 = 0
    UNION ALL SELECT {K}, 'prompt_not_terminated_by_empty_target_signature', '' FROM part WHERE {K} % 5 = 0 OR ({K} % 7 = 0 AND {K} % 23 <> 0)
    UNION ALL SELECT {K}, 'bad_api_name_leaked_in_prompt', '' FROM part WHERE {K} % 13 = 0
    UNION ALL SELECT {K}, 'candidate_prelude_contains_function_definition', CASE WHEN {K} % 6 = 0 THEN 'helper_exp' ELSE 'odd' END FROM part WHERE ({K} % 6 = 0 AND NOT ({K} % 4 = 0 AND {K} % 12 < 6)) OR {K} % 6 = 1
    UNION ALL SELECT {K}, 'missing_response_contract', '' FROM part WHERE {K} % 9 = 0
    UNION ALL SELECT {K}, 'response_contract_missing_forbidden_tokens', CASE WHEN {K} % 8 = 0 THEN '#include,int main' ELSE '#include,```,int main' END FROM part WHERE {K} % 8 IN (0, 1)
    UNION ALL SELECT {K}, 'harness_extern_signature_mismatch', '' FROM part WHERE {K} % 11 = 1 OR ({K} % 11 = 0 AND {K} % 23 = 0)
    UNION ALL SELECT {K}, 'parent_signature_mismatch', CASE WHEN {K} % 10 = 3 THEN 'int parent(int n)' ELSE {SIG} END FROM part WHERE {K} % 4 = 0 AND ({K} % 10 = 3 OR ({K} % 10 = 4 AND {K} % 23 = 0))
    UNION ALL SELECT {K}, 'local_syntax_smoke_fail', 'no compiler here' FROM part WHERE NOT ({K} % 3 = 0 OR ({K} % 3 = 1 AND {K} % 2 = 0)))"""


@query(f"WITH {D_FOUND} SELECT id, kind, detail FROM found")
def q136_contract_findings(spark, sf_dir):
    """All nine kinds of findings."""
    return tasks(spark, sf_dir)[1]


@query(f"""WITH {D_FOUND}, r AS (SELECT 'b' || ({K} % 4) AS benchmark, count(*) AS rows, count(*) FILTER ({K} % 3 = 0 OR ({K} % 3 = 1 AND {K} % 2 = 0)) AS smoke_pass FROM part GROUP BY ALL),
        f AS (SELECT 'b' || (id % 4) AS benchmark, count(*) AS issues, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in contracts.KINDS)} FROM found GROUP BY ALL)
        SELECT benchmark, rows, issues, smoke_pass, rows - smoke_pass AS smoke_fail, {", ".join(contracts.KINDS)} FROM r JOIN f USING (benchmark)""")
def q137_contract_totals(spark, sf_dir):
    return contracts.contract_totals(*tasks(spark, sf_dir), "benchmark", "id")


D_SHAPES = rf"""c AS (SELECT {K} AS id, {HARD} AS code FROM part), n AS (SELECT DISTINCT id, unnest(regexp_extract_all(code, '([A-Za-z_]\w*)\s*{NESTED}\s*\{{', 1)) AS name, p_size % 30 AS shape FROM c JOIN part ON {K} = id),
    x AS (SELECT id, name, CASE WHEN shape % 2 = 0 THEN 'p' ELSE '' END || CASE WHEN shape % 3 = 0 THEN 'm' ELSE '' END || CASE WHEN shape % 5 = 0 THEN 'd' ELSE '' END AS shape FROM n WHERE name NOT IN {D_CONTROL} AND name <> 'fn')"""


@query(f"""WITH {D_SHAPES} SELECT b.name, b.name IN {among(*code.GENERIC)} AS generic, count(*) AS pairs, count(*) FILTER (b.shape = c.shape) AS same_shape, count(*) FILTER (b.name NOT IN {among(*code.GENERIC)} OR b.shape = c.shape) AS notable
        FROM x b JOIN x c USING (name) WHERE b.id % 10 = 0 AND c.id % 10 <> 0 GROUP BY b.name""")
def q138_function_name_matches(spark, sf_dir):
    """Functions of one name on both sides: pairs, those whose first signatures have types of one shape, and those that count, as the name is no common one or the shapes agree.

    Counted by name and shape on either side, so that no pair is written.
    """
    rows = spread(table(spark, sf_dir, "part")).selectExpr(f"{K} AS id", f"{HARD} AS code")
    heads = text.barrier(rows.select("id", code.function_heads(F.col("code")).alias("h")), "h")
    shape = code.type_shape(F.coalesce(F.get("h", 0)["head"], F.lit("")))
    named = heads.select("id", shape.alias("shape"), F.explode(F.array_distinct(F.transform("h", lambda x: x["name"]))).alias("name"))
    side = lambda where, n: named.where(where).groupBy("name", "shape").agg(F.count(F.lit(1)).alias(n))
    b, c = side("id % 10 = 0", "nb"), side("id % 10 <> 0", "nc")
    same = b.join(c, ["name", "shape"]).groupBy("name").agg(F.sum(F.col("nb") * F.col("nc")).alias("same_shape"))
    every = b.groupBy("name").agg(F.sum("nb").alias("nb")).join(c.groupBy("name").agg(F.sum("nc").alias("nc")), "name").join(same, "name", "left")
    generic, pairs = F.col("name").isin(*code.GENERIC), F.col("nb") * F.col("nc")
    counted = F.coalesce("same_shape", F.lit(0).cast("bigint"))
    return every.select("name", generic.alias("generic"), pairs.alias("pairs"), counted.alias("same_shape"), F.when(generic, counted).otherwise(pairs).alias("notable"))


@query(f"""SELECT {K} AS id, CASE WHEN {K} % 2 = 0 THEN 'ret=unsigned NAME|params=float*NAME,const char*(*f)(void)' ELSE 'ret=static std::map<int, std::vector<std::pair<int, float>>>|params=int NAME'
          || CASE WHEN p_size % 2 = 0 THEN ',int (*cb)(int, float (*)(int))' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ',std::map<int, std::vector<std::pair<int, int>>>&NAME' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ',int d = g(1, h(2, 3))' ELSE '' END END AS key FROM part""")
def q139_signature_keys(spark, sf_dir):
    """Types of the last function of every snippet; the key for the SQL is put together from the row's numbers."""
    return spread(table(spark, sf_dir, "part")).selectExpr(f"{K} AS id", f"{HARD} AS code").select("id", code.signature_key(F.col("code")).alias("key"))


MODES = f"CASE WHEN {K} % 5 = 0 THEN 'c11, cxx17 ,c11' WHEN {K} % 5 = 1 THEN ' c11' WHEN {K} % 5 = 2 THEN 'rust,,' WHEN {K} % 5 = 3 THEN 'cxx17,asm,c11' END"


@query(f"SELECT {K} AS id, CASE {K} % 5 WHEN 0 THEN 'c11,cxx17' WHEN 1 THEN 'c11' WHEN 3 THEN 'cxx17,c11' ELSE 'cxx17' END AS modes FROM part")
def q140_compile_modes(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(f"{K} AS id", f"{MODES} AS raw").select("id", F.array_join(code.known_modes(F.col("raw")), ",").alias("modes"))


@query("SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS idx FROM events")
def q141_running_index(spark, sf_dir):
    """Rows of several splits numbered from 1 on in one go: by the split's rank, then by place."""
    rank = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rows = table(spark, sf_dir, "events").select("event_id", "ts", rank.alias("split"))
    return ordering.running_index(rows, ["split", "ts", "event_id"], "idx")[0].select("event_id", (F.col("idx") + 1).alias("idx"))


MUST = "The result has to be exact"
NOTES = {"Keep row pointers.": "ROWPTR", "Tables are set up already.": "table"}
COMMENT = f"""'before' || chr(10) || CASE WHEN {K} % 4 = 3 THEN '' ELSE '/* ' END || chr(10) || ' * about ' || p_name || CASE WHEN {K} % 3 = 0 THEN ' with a table' ELSE '' END || chr(10) || chr(10) || chr(10) || chr(10) || '   * more' || CASE WHEN {K} % 5 = 0 THEN ' ROWPTR' ELSE '' END || chr(10)
    || CASE WHEN {K} % 2 = 0 THEN ' {MUST}.' || chr(10) || 'and so on' || chr(10) ELSE '' END || CASE WHEN {K} % 4 = 3 THEN '' ELSE '*/' || chr(10) || 'after' END"""
D_BODY = f"CASE WHEN {K} % 4 = 3 THEN 'before' || chr(10) ELSE '' END || 'about ' || p_name || CASE WHEN {K} % 3 = 0 THEN ' with a table' ELSE '' END || chr(10) || 'more' || CASE WHEN {K} % 5 = 0 THEN ' ROWPTR' ELSE '' END"
D_SAID = f"CASE WHEN {K} % 5 = 0 OR {K} % 3 = 0 THEN body || chr(10) || chr(10) || array_to_string([n for n in [CASE WHEN {K} % 5 = 0 THEN 'Keep row pointers.' END, CASE WHEN {K} % 3 = 0 THEN 'Tables are set up already.' END] if n IS NOT NULL], chr(10)) ELSE body END"


@query(f"""WITH b AS (SELECT *, {D_BODY} AS body FROM part), s AS (SELECT *, {D_SAID} AS said FROM b)
        SELECT {K} AS id, '#include <v.h>' || chr(10) || chr(10) || CASE WHEN {K} % 7 = 0 THEN '#define N 3' || chr(10) || chr(10) ELSE '' END || '/*' || chr(10) || said || chr(10) || chr(10) || '{MUST}' || chr(10) || '*/' || chr(10) || chr(10) || {SIG} || ' {{' || chr(10) || '}}' || chr(10) AS prompt FROM s""".replace("{{", "{").replace("}}", "}"))
def q142_prompts(spark, sf_dir):
    """Prompts from what comments say, with notes and one requirement; for the SQL they are put together from the row's numbers."""
    rows = spread(table(spark, sf_dir, "part")).selectExpr(f"{K} AS id", f"{COMMENT} AS comment", f"{SIG} AS sig", f"CASE WHEN {K} % 7 = 0 THEN ' #define N 3 ' ELSE ' ' END AS prelude")
    body = prompts.comment_body(F.col("comment"), MUST)
    said = prompts.with_notes(body, {note: F.contains(body, F.lit(word)) for note, word in NOTES.items()})
    return rows.select("id", prompts.prompt_text(F.col("sig"), said, F.col("prelude"), "#include <v.h>", MUST).alias("prompt"))


@query(f"""WITH t AS (SELECT {K} AS id, p_type, CASE p_type WHEN 'ECONOMY' THEN 'sequential' WHEN 'SMALL' THEN 'hybrid' ELSE 'pure' END AS strategy, {K} % 3 = 0 AS d, {K} % 4 = 0 OR {K} % 5 = 0 AS s FROM part)
        SELECT id, strategy, d OR s AS needs_context, CASE strategy WHEN 'sequential' THEN 'order of work matters' WHEN 'hybrid' THEN 'scalar control around vector work' ELSE 'one loop of vector work' END || CASE WHEN d THEN ';prelude defines names' ELSE '' END || CASE WHEN s THEN ';signature has types of its own' ELSE '' END AS reasons,
          CASE WHEN strategy = 'sequential' THEN 'sequential_holdout' WHEN d OR s THEN 'requires_context_prelude' WHEN strategy = 'hybrid' THEN 'hybrid_single_function' ELSE 'pure_sve_single_function' END AS category FROM t""")
def q143_task_strategies(spark, sf_dir):
    """Strategy, reasons and category of every task; a table lists the ones that are not pure."""
    listed = spark.createDataFrame([("ECONOMY", "sequential"), ("SMALL", "hybrid")], "p_type string, listed string")
    rows = table(spark, sf_dir, "part").selectExpr(f"{K} AS id", "p_type", f"CASE WHEN {K} % 3 = 0 THEN 'int a;' || chr(10) || ' typedef int T;' WHEN {K} % 3 = 1 THEN 'a typedef' END AS prelude", f"CASE WHEN {K} % 4 = 0 THEN 'void f(std::string s)' WHEN {K} % 5 = 0 THEN 'void f(ROWPTR r)' ELSE 'void f(int n)' END AS sig")
    # Two rows.
    found = rows.join(F.broadcast(listed), "p_type", "left").select("id", prompts.strategy(F.col("listed"), F.col("prelude"), F.col("sig"), ("ROWPTR", "BLOCK")).alias("s"))
    return found.select("id", "s.strategy", "s.needs_context", F.array_join("s.reasons", ";").alias("reasons"), features.primary_category(F.col("s.strategy"), F.col("s.needs_context"), F.lit(False)).alias("category"))


@query(f"""SELECT {K} AS id, CASE {K} % 3 WHEN 0 THEN 'int main() {{ puts("correctness"); }}' WHEN 1 THEN 'void t();' ELSE 'int x;' || chr(10) || 'static int checked_main(void) {{ return t(); }}' || chr(10) || chr(10) || 'int main(void) {{' || chr(10) || '    int rc = checked_main();' || chr(10)
        || '    printf("{{ ' || chr(92) || '"correctness' || chr(92) || '": %s }}' || chr(92) || 'n", rc == 0 ? "1" : "0");' || chr(10) || '    return 0;' || chr(10) || '}}' || chr(10) END AS harness, 'extern void f' || ({K} % 20) || '(float *a, int n);' AS declared FROM part""".replace("{{", "{").replace("}}", "}"))
def q144_harnesses(spark, sf_dir):
    made = F.when(F.col("id") % 3 == 0, '```c\nint main() { puts("correctness"); }\n```').when(F.col("id") % 3 == 1, " void t(); ").otherwise("int x;\nint  main ( void ) { return t(); }\n ")
    rows = table(spark, sf_dir, "part").selectExpr(f"{K} AS id", f"' ' || {SIG} || ';; ' AS sig")
    return rows.select("id", prompts.reporting_harness(made).alias("harness"), prompts.extern_declaration(F.col("sig")).alias("declared"))
