"""Queries of dumped syntax trees: digests, feature lists, semantic patterns, and the matches on them.

The tables hold no trees, so one is put together for each row of `part`: functions whose
statements (loops of three kinds, nested ones, branches, calls, declarations,
assignments of several operators) depend on the row's numbers, a tree without a
function, and texts that are no tree. DuckDB reads the same texts with json_tree
and works on pairs of a node and what is below it; Spark slices flat arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import code, patterns, trees
from corvid.functions.text import barrier
from corvid.plans.code_catalog import SNIPPET, among
from corvid.plans.registry import query
from corvid.sources.tables import spread, table

# A node as pieces of its JSON: text as it stands, or (sql,).


def sql_of(pieces: list) -> str:
    out, held = [], ""
    for p in [*pieces, None]:
        if isinstance(p, str):
            held += p
            continue
        if held:
            out.append("'" + held.replace("'", "''") + "'")
            held = ""
        if p is not None:
            out.append(p[0])
    return " || ".join(out)


def node(kind: str, *kids: list, text="", field: str | None = None, named: bool = True) -> list:
    head = ['{"type":"', kind, '"'] + ([] if named else [',"named":false']) + ([',"field":"', field, '"'] if field else []) + ([',"text":"', *([text] if isinstance(text, str) else text), '"'] if text else [])
    body: list = []
    for k in kids:
        # An optional node brings its comma with it.
        body += k if k[0] == "?" else [*k, ","]
    body = [p for p in body if p != "?"]
    return head + ([',"children":[', *body[:-1], "]"] if kids else []) + ["}"]


def sometimes(when: str, n: list) -> list:
    return ["?", (f"CASE WHEN {when} THEN {sql_of([*n, ','])} ELSE '' END",)]


def one_of(number: str, *texts: str) -> list:
    return [("CASE " + number + " " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(texts[:-1])) + f" ELSE '{texts[-1]}' END",)]


name = lambda t, field=None: node("identifier", text=t, field=field)
number = lambda t, field=None: node("number_literal", text=t, field=field)
mark = lambda t: node("other", text=t, named=False)
item = lambda a, at, field=None: node("subscript_expression", name(a, "argument"), node("subscript_argument_list", mark("["), at, mark("]")), field=field)
two = lambda a, op, b, field=None: node("binary_expression", a, mark(op), b, field=field)
put = lambda a, op, b: node("expression_statement", node("assignment_expression", a, mark(op), b), mark(";"))
call = lambda f, *args, field=None: node("call_expression", name(f, "function"), node("argument_list", mark("("), *args, mark(")")), field=field)
block = lambda *kids, field="body": node("compound_statement", mark("{"), *kids, mark("}"), field=field)
plain_type = lambda t: node("primitive_type", text=t, field="type")
K, S = "p_partkey", "p_size"
digits = lambda of, most: [(f"cast({of} % {most} AS string)",)]
counter = node("declaration", plain_type("int"), node("init_declarator", name("i"), mark("="), number("0")), mark(";"), field="initializer")
count_loop = lambda end, *body: node("for_statement", mark("for"), mark("("), counter, two(name("i", "left"), "<", end, field="condition"), node("update_expression", name("i"), mark("++"), field="update"), mark(")"), block(*body))
STATEMENTS = [
    (f"{K} % 2 = 0", count_loop(number(digits(S, 9), "right"), put(item("a", name("i"), "left"), one_of(f"{K} % 4", "=", "=", "+="), two(item("b", two(name("i"), "+", number(digits(K, 3)))), "*", item("c", name("i")), "right")))),
    (f"{K} % 3 = 0", node("while_statement", mark("while"), node("condition_clause", mark("("), two(name("k"), ">>", number("1")), mark(")"), field="condition"), block(node("expression_statement", call(one_of(f"{K} % 2", "svld1_gather_s32offset", "svadd_f32_x"), name("pg"))), put(name("k", "left"), ">>=", number("1", "right"))))),
    (f"{K} % 5 = 0", node("do_statement", mark("do"), block(count_loop(name("n", "right"), sometimes(f"{K} % 10 = 0", count_loop(name("m", "right"), put(item("d", name("j"), "left"), "*=", item("d", name("i"), "right")))), put(item("s", number("0"), "left"), "+=", item("e", item("f", name("i")), "right")))), mark("while"), two(name("s"), "!=", number("0"), field="condition"))),
    (f"{K} % 7 = 0", node("if_statement", mark("if"), node("condition_clause", mark("("), two(item("a", number("0")), ">", number(digits(S, 2))), mark(")"), field="condition"), node("return_statement", mark("return"), item("a", number("1")), mark(";")))),
    (f"{K} % 6 = 1", put(name("r", "left"), "=", call("sqrtf", number("2.5"), field="right"))),
    (f"{K} % 11 = 0", put(node("field_expression", name("q"), mark("->"), node("field_identifier", text="v"), field="left"), "=", node("conditional_expression", node("unary_expression", mark("!"), name("c")), mark("?"), number("1"), mark(":"), number("2"), field="right"))),
    (f"{K} % 4 = 3", node("declaration", node("template_type", node("type_identifier", text="vector"), node("template_argument_list", mark("<"), node("type_descriptor", node("primitive_type", text=one_of(f"{S} % 2", "float", "double"))), mark(">")), text=["std::vector<  ", *one_of(f"{S} % 2", "float", "double"), ">"]), name("v"), mark(";"))),
    (f"{K} % 9 = 0", node("expression_statement", call("log_it", node("string_literal", node("string_content", text="x"), text="x")))),
]
function = lambda called, *body: node("function_definition", plain_type(one_of(f"{S} % 3", "void", "int", "unsigned long")), node("function_declarator", name(called, "declarator"), node("parameter_list", mark("("), node("parameter_declaration", plain_type("float"), node("pointer_declarator", mark("*"), name("a"))), mark(")")), field="declarator"), block(*body))
DONE = node("return_statement", mark("return"), name("r"), mark(";"))
WHOLE = node("translation_unit", sometimes(f"{K} % 4 = 1", function("helper", DONE)), function(["fn", *digits(K, 50)], *(sometimes(w, s) for w, s in STATEMENTS), DONE))
BARE = node("translation_unit", put(item("a", number("0"), "left"), "=", two(name("x"), "-", number("1"), "right")))
TREE = f"CASE WHEN {K} % 17 = 16 THEN 'no tree' WHEN {K} % 13 = 12 THEN {sql_of(BARE)} ELSE {sql_of(WHOLE)} END"

# The same in DuckDB: every node with what is below it, as rows.
LEAF = f"(NOT named OR kind IN {among(*trees.NAMES, *trees.NUMBERS, *trees.STRINGS)} OR contains(kind, 'type'))"
d_word = lambda typed, names: f"CASE WHEN kind IN {among(*trees.NAMES)} THEN {'trim(txt)' if names else chr(39) + 'ID' + chr(39)} WHEN kind IN {among(*trees.NUMBERS)} THEN 'NUM' WHEN kind IN {among(*trees.STRINGS)} THEN 'STR' WHEN contains(kind, 'type') THEN {chr(39) + 'TYPE:' + chr(39) + ' || trim(txt)' if typed else chr(39) + 'TYPE' + chr(39)} END"
d_tag = lambda typed: f"CASE WHEN sealed THEN '' WHEN NOT named THEN CASE WHEN txt IN {among(*trees.OPERATORS, *trees.BRACKETS)} THEN txt ELSE '' END ELSE coalesce({d_word(typed, False)}, kind) END"
d_open = lambda names: f"CASE WHEN sealed THEN '' WHEN NOT named THEN CASE WHEN txt IN {among(*trees.OPERATORS)} THEN txt ELSE '' END ELSE coalesce({d_word(False, names)}, '(' || kind) END"
d_text = lambda c, sep: f"coalesce(string_agg(NULLIF({c}, ''), {sep} ORDER BY spot, ord, deep), '')"
D_TREES = f"""WITH tree AS (SELECT * FROM (SELECT p_partkey AS id, {TREE} AS j FROM part) WHERE starts_with(j, '{{')),
    raw AS (SELECT tree.id, row_number() OVER (PARTITION BY tree.id ORDER BY t.id) - 1 AS pos, fullkey AS k, CASE WHEN fullkey <> '$' THEN left(path, length(path) - 9) END AS up, json_extract_string(value, '$.type') AS kind, coalesce(json_extract_string(value, '$.named'), 'true') = 'true' AS named,
      coalesce(json_extract_string(value, '$.text'), '') AS txt, json_extract_string(value, '$.field') AS field, (length(fullkey) - length(replace(fullkey, '.children[', ''))) // 10 AS depth FROM tree, json_tree(tree.j) t WHERE t.type = 'OBJECT'),
    pair AS (SELECT a.id, a.pos AS root, a.kind AS root_kind, a.k AS root_k, d.pos FROM raw a JOIN raw d ON a.id = d.id AND (d.k = a.k OR starts_with(d.k, a.k || '.'))),
    seal AS (SELECT DISTINCT p.id, p.pos FROM pair p JOIN raw a ON a.id = p.id AND a.pos = p.root WHERE p.pos > p.root AND {LEAF}),
    n AS (SELECT raw.*, s.pos IS NOT NULL AS sealed, z.size FROM raw LEFT JOIN seal s USING (id, pos) JOIN (SELECT id, root AS pos, count(*) AS size FROM pair GROUP BY ALL) z USING (id, pos)),
    ev AS (SELECT id, pos, pos AS spot, 1 AS ord, 0 AS deep, {d_tag(True)} AS typed, {d_tag(False)} AS untyped, {d_open(False)} AS plain, {d_open(True)} AS names FROM n
      UNION ALL SELECT id, pos, pos + size, 0, -depth, t, t, p, p FROM (SELECT id, pos, size, depth, CASE WHEN sealed OR {LEAF} THEN '' ELSE '/' || kind END AS t, CASE WHEN sealed OR {LEAF} THEN '' ELSE ')' END AS p FROM n))"""
D_FEATURES = f"""{D_TREES},
    c AS (SELECT id, root AS pos, {d_text("typed", "chr(10)")} AS typed, {d_text("untyped", "chr(10)")} AS untyped, replace({d_text("plain", "' '")}, ' )', ')') AS plain, replace({d_text("names", "' '")}, ' )', ')') AS names FROM pair JOIN ev USING (id, pos) GROUP BY id, root),
    e AS (SELECT n.*, c.plain, c.names, c.typed, c.untyped FROM n JOIN c USING (id, pos)),
    f AS (SELECT id, pos FROM n WHERE kind = 'function_definition'), r AS (SELECT * FROM f UNION ALL SELECT id, 0 FROM tree WHERE id NOT IN (SELECT id FROM f)),
    h AS (SELECT r.pos AS root, e.* FROM r JOIN pair p ON p.id = r.id AND p.root = r.pos JOIN e ON e.id = p.id AND e.pos = p.pos),
    kid AS (SELECT p.id, p.k, field, first(plain ORDER BY pos) AS plain, first(names ORDER BY pos) AS names, first(pos ORDER BY pos) AS pos FROM (SELECT id, up AS k, field, plain, names, pos FROM e WHERE field IS NOT NULL) p GROUP BY ALL),
    sign AS (SELECT id, up AS k, first(txt ORDER BY pos) AS op FROM e WHERE NOT named AND txt IN {among(*code.ASSIGN)} GROUP BY ALL),
    one AS (SELECT h.*, coalesce(x.plain, '') AS l, coalesce(y.plain, '') AS rr, y.pos AS rat, coalesce(o.op, '=') AS op, coalesce(q.plain, '') AS q, coalesce(b.plain, '') AS b, coalesce(u.plain, '') AS u, coalesce(g.names, '') AS g FROM h
      LEFT JOIN kid x ON x.id = h.id AND x.k = h.k AND x.field = 'left' LEFT JOIN kid y ON y.id = h.id AND y.k = h.k AND y.field = 'right' LEFT JOIN sign o ON o.id = h.id AND o.k = h.k LEFT JOIN kid q ON q.id = h.id AND q.k = h.k AND q.field = 'condition'
      LEFT JOIN kid b ON b.id = h.id AND b.k = h.k AND b.field = 'initializer' LEFT JOIN kid u ON u.id = h.id AND u.k = h.k AND u.field = 'update' LEFT JOIN kid g ON g.id = h.id AND g.k = h.k AND g.field = 'function'),
    it AS (SELECT id, 'loop_nest' AS part, kind || ':init=' || b || ':cond=' || q || ':upd=' || u AS x FROM one WHERE kind IN {among(*trees.LOOPS)}
      UNION ALL SELECT id, 'array_access', plain FROM one WHERE kind = 'subscript_expression' UNION ALL SELECT id, 'assignment_tree', l || op || rr FROM one WHERE kind = 'assignment_expression'
      UNION ALL SELECT id, 'expression_tree', plain FROM one WHERE kind IN {among(*trees.EXPRESSIONS)}
      UNION ALL SELECT id, 'call_graph', CASE WHEN contains(g, 'sv') THEN regexp_replace(g, '_[suf](8|16|32|64).*', '_T') WHEN len([m for m in [{", ".join(f"'{m}'" for m in code.MATH)}] if contains(g, m)]) > 0 THEN 'math:' || g ELSE 'call' END FROM one WHERE kind = 'call_expression'
      UNION ALL SELECT id, 'returns', plain FROM one WHERE kind = 'return_statement' UNION ALL SELECT id, 'conditions', q FROM one WHERE kind = 'if_statement' UNION ALL SELECT id, 'writes', l FROM one WHERE kind = 'assignment_expression'
      UNION ALL SELECT o.id, 'reads', e.plain FROM one o JOIN pair p ON p.id = o.id AND p.root = o.rat JOIN e ON e.id = p.id AND e.pos = p.pos WHERE o.kind = 'assignment_expression' AND e.kind = 'subscript_expression'
      UNION ALL SELECT id, 'types', trim(regexp_replace(txt, '\\s+', ' ', 'g')) FROM one WHERE contains(kind, 'type') AND txt <> ''),
    s AS (SELECT id, part, string_agg(x, chr(10) ORDER BY x) AS lines, string_agg(x, '|' ORDER BY x) AS bars, list(x ORDER BY x) AS every, list(DISTINCT x ORDER BY x) AS once FROM it GROUP BY id, part),
    w AS (SELECT tree.id, {", ".join(f"max(bars) FILTER (part = '{p}') AS {p}_b, max(lines) FILTER (part = '{p}') AS {p}_l, coalesce(max({'every' if p == 'loop_nest' else 'once'}) FILTER (part = '{p}'), [])[1:{n}] AS {p}" for p, n in trees.LISTS.items())} FROM tree LEFT JOIN s USING (id) GROUP BY tree.id),
    top AS (SELECT r.id, string_agg(typed, chr(10) ORDER BY r.pos) AS typed, string_agg(untyped, chr(10) ORDER BY r.pos) AS untyped FROM r JOIN c USING (id, pos) GROUP BY r.id),
    nest AS (SELECT o.id, max((SELECT count(*) FROM pair p WHERE p.id = o.id AND p.pos = o.pos AND p.root >= o.root AND p.root_kind IN {among(*trees.LOOPS)})) AS depth FROM h o WHERE o.kind IN {among(*trees.LOOPS)} GROUP BY o.id),
    d AS (SELECT w.id, (SELECT count(*) FROM f WHERE f.id = w.id) AS functions, coalesce(nest.depth, 0)::BIGINT AS max_loop_depth, sha256(typed) AS typed_ast_hash, sha256(untyped) AS untyped_ast_hash, {", ".join(f"sha256(coalesce({p}_l, '')) AS {p}_hash" for p in trees.DIGESTS[2:7])},
      sha256('loops:' || coalesce(loop_nest_b, '') || chr(10) || 'arrays:' || coalesce(array_access_b, '') || chr(10) || 'assign:' || coalesce(assignment_tree_b, '') || chr(10) || 'calls:' || coalesce(call_graph_b, '') || chr(10) || 'returns:' || coalesce(returns_b, '')) AS composite_hash, {", ".join(trees.LISTS)}
      FROM w JOIN top USING (id) LEFT JOIN nest USING (id))"""
HASHES = [f"{d}_hash" for d in trees.DIGESTS]


def shapes_of(spark: SparkSession, sf_dir: str, *more, sources=(S,)) -> DataFrame:
    """(ids, key, sources): all rows of one shape of trees (and of equal shapes of `more`), and the sources of the first; texts are put together from them again rather than sent."""
    parts = table(spark, sf_dir, "part")
    groups = trees.shape_groups(spread(parts), K, [trees.shape_text(F.expr(TREE)), *more], list(sources), parts.count())
    return spread(groups.withColumn(K, F.col("ids")[0]))


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ids, features) of every shape of trees."""
    rows = shapes_of(spark, sf_dir).selectExpr("ids", f"{TREE} AS j")
    return trees.tree_features(barrier(rows.select("ids", trees.parsed_nodes("j").alias("nodes")), "nodes"), "ids", "nodes")


def each(groups: DataFrame, *columns) -> DataFrame:
    """A row for each id of groups with `ids`; columns are worked out once a group."""
    done = groups.select("ids", *columns)
    return done.select(F.explode("ids").alias("id"), *done.columns[1:])


# Eight of forty rows stand for the benchmark.
benched = lambda: F.filter("ids", lambda i: i % 40 < 8)
cored = lambda: F.filter("ids", lambda i: i % 40 >= 8)


def counted(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys, matches, first_core_id): how many rows of the core have each value of the keys, and the first of them."""
    own = groups.select(*keys, cored().alias("core")).where(F.size("core") > 0)
    return own.select(*keys, F.size("core").cast("bigint").alias("n"), F.array_min("core").alias("first")).groupBy(*keys).agg(F.sum("n").alias("matches"), F.min("first").alias("first_core_id"))


def matched(groups: DataFrame, *keys: str) -> DataFrame:
    """(bench_id, first key, matches, first_core_id) of every row of the benchmark and its values of the keys that the core has too; groups meet before they are taken apart."""
    bench = groups.select(benched().alias("bench"), *keys).where(F.size("bench") > 0)
    return bench.join(counted(groups, *keys).hint("merge"), list(keys)).select(F.explode("bench").alias("bench_id"), keys[0], "matches", "first_core_id")


@query(f"{D_FEATURES} SELECT id, functions, max_loop_depth, {', '.join(HASHES)} FROM d")
def q123_tree_digests(spark, sf_dir):
    """Eight digests of every tree, with the number of its functions and how deep its loops are nested."""
    return each(features_of(spark, sf_dir), "functions", "max_loop_depth", *HASHES)


@query(f"{D_FEATURES} SELECT id, {', '.join(f'''array_to_string({p}, chr(10)) AS {p}''' for p in trees.LISTS)} FROM d")
def q124_tree_lists(spark, sf_dir):
    """The ten feature lists of every tree, in lines."""
    return each(features_of(spark, sf_dir), *(F.array_join(p, "\n").alias(p) for p in trees.LISTS))


@query(f"""{D_FEATURES}, u AS (SELECT id, unnest({list(trees.DIGESTS)}) AS component, unnest([{", ".join(HASHES)}]) AS digest FROM d)
    SELECT b.id AS bench_id, b.component, count(*) AS matches, min(c.id) AS first_core_id FROM u b JOIN u c USING (component, digest) WHERE b.id % 40 < 8 AND c.id % 40 >= 8 AND digest <> sha256('') GROUP BY b.id, b.component""")
def q125_tree_digest_matches(spark, sf_dir):
    """For every tree of the benchmark (eight of forty) and each digest: how many of the other trees have it too, and the first of them; the digest of nothing never matches.

    The core is counted by digest before the join, so a common shape stays one row.
    """
    return matched(trees.digest_rows(features_of(spark, sf_dir), "ids"), "component", "digest")


# Semantic patterns, of a row's snippet (which varies little) and its tree.
D_HEAD = r"trim(regexp_replace(regexp_extract(code, '(?:^|\n)\s*([A-Za-z_][\w:<>,\s*&]*?\s+[A-Za-z_]\w*\s*\([^;{}]*\))\s*\{', 1), '\s+', ' ', 'g'))"
D_BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(code, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g'), '"(?:\\.|[^"\\])*"', ' STR ', 'g'), '''(?:\\.|[^''\\])*''', ' CHR ', 'g')"""
d_some = lambda *rules: "[x for x in [" + ", ".join(f"CASE WHEN {r} THEN '{k}' END" for k, r in sorted(rules)) + "] if x IS NOT NULL]"
d_has = lambda *parts: "(" + " OR ".join(f"contains(bare, '{p}')" for p in parts) + ")"
d_set = lambda x: f"list_sort(list_distinct({x}))"
d_times = lambda w: f"((length(bare) - length(replace(bare, '{w}', ''))) // {len(w)})"
D_LAYOUT = d_some(("interleaved_or_pair", rf"{d_has('svld2', 'svst2')} OR regexp_matches(bare, '\b2\s*\*')"), ("tuple_channel", d_has("svld3", "svst3", "svld4", "svst4")), ("gather", d_has("gather")), ("scatter", d_has("scatter")), ("aos_or_struct", d_has(".", "->")), ("affine_index", "len([a for a in array_access if contains(a, '*') OR contains(a, '+')]) > 0"))
D_REDUCED = d_some(("sum_or_reduce", r"regexp_matches(bare, '\+=|svaddv|svmaxv|svminv')"), ("product", r"regexp_matches(bare, '(?i)\*=|product')"), ("while_control", r"regexp_matches(bare, '\bwhile\s*\(')"), ("predicate_test", d_has("svcntp", "svptest")))
D_MARKED = "[p for p in [trim(p) for p in string_split(regexp_extract(s, '(?s)\\((.*)\\)', 1), ',')] if p NOT IN ('', 'void')]"
D_PATTERNS = rf"""{D_FEATURES},
    src AS (SELECT d.*, {D_HEAD} AS s, {D_BARE} AS bare FROM d JOIN (SELECT p_partkey AS id, {SNIPPET} AS code FROM part) USING (id)),
    par AS (SELECT id, k, list_filter(regexp_extract_all(p, '{code.TOKENS}'), lambda t: true) AS t FROM (SELECT id, unnest({D_MARKED}) AS p, generate_subscripts({D_MARKED}, 1) AS k FROM src)),
    shp AS (SELECT id, count(*) AS arity, list({{'ptr_level': len([x for x in t if x IN ('*', '&')]), 'types': [x for x in t if x IN {among(*code.TYPES, 'const')}]}} ORDER BY k) AS params FROM par GROUP BY id),
    pat AS (SELECT src.id, {d_set("list_concat([f for f in " + str(list(patterns.FLOWS)) + " if contains(bare, f)], types)")}[1:{patterns.MOST_FLOWS}] AS data_type_flow, {{'for_count': {d_times('for')}, 'loop_count': len(loop_nest), 'max_depth': max_loop_depth, 'while_count': {d_times('while')}}} AS loop_domain,
      [m for m in {sorted(code.MATH)} if regexp_matches(bare, '\b' || m || '\b')] AS math_calls, CASE WHEN len({D_LAYOUT}) > 0 THEN {D_LAYOUT} ELSE ['contiguous_or_scalar'] END AS memory_layout_class, {d_set("regexp_extract_all(bare, '" + patterns.OPERATOR + "')")} AS ops, conditions, reads, {D_REDUCED} AS reduced,
      coalesce(arity, 0) AS arity, coalesce(params, []) AS params, array_to_string([x for x in regexp_extract_all(split_part(s, '(', 1), '{code.TOKENS}') if x IN {among(*code.TYPES)}], ' ') AS returned, writes, {', '.join(HASHES)} FROM src LEFT JOIN shp USING (id)),
    keys AS (SELECT *, sha256(to_json({{'data_type_flow': data_type_flow, 'loop_domain': loop_domain, 'math_calls': math_calls, 'memory_layout_class': memory_layout_class, 'ops': ops, 'predicate_condition': conditions, 'read_index_shape': reads, 'reduction_operator': reduced, 'signature_shape': {{'arity': arity, 'params': params, 'return': returned}}, 'write_target_shape': writes}})::VARCHAR) AS strict_hash,
      sha256(to_json({{'arity': arity, 'loop_domain': loop_domain, 'memory_layout_class': memory_layout_class, 'ops': ops, 'read_index_shape': reads, 'reduction_operator': reduced, 'write_target_shape': writes}})::VARCHAR) AS abstract_hash FROM pat)"""


def semantic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ids, strict_hash, abstract_hash, digests) of rows whose tree can be read, those of one shape of trees and of code together.

    A group's facts go through the tree features with its ids, so that nothing is joined.
    """
    rows = shapes_of(spark, sf_dir, patterns.code_shape(F.expr(SNIPPET)), sources=(S, "p_name", "p_type", "p_brand")).selectExpr("ids", f"{SNIPPET} AS code", f"{TREE} AS j")
    own = F.struct(patterns.bare_code(F.col("code")).alias("bare"), code.signature(F.col("code")).alias("sig"))
    read = barrier(rows.select("ids", "j", own.alias("own")), "own")
    facts = barrier(read.select("ids", "j", patterns.code_facts(F.col("own.bare"), F.col("own.sig")).alias("facts")), "facts")
    parsed = barrier(facts.select(F.struct("ids", "facts").alias("own"), trees.parsed_nodes("j").alias("nodes")), "nodes").where("nodes IS NOT NULL")
    both = trees.tree_features(parsed, "own", "nodes").select("own.*", "*")
    pattern = patterns.semantic_pattern(F.col("facts"), {k: F.col(k) for k in ("max_loop_depth", *trees.LISTS)})
    keyed = barrier(both.select("ids", *HASHES, pattern.alias("pattern")), "pattern")
    return keyed.select("ids", patterns.strict_key(F.col("pattern")).alias("strict_hash"), patterns.abstract_key(F.col("pattern")).alias("abstract_hash"), *HASHES)


@query(f"{D_PATTERNS} SELECT id, strict_hash, abstract_hash FROM keys")
def q126_semantic_hashes(spark, sf_dir):
    """The strict and the abstract key of every row's semantic pattern."""
    return each(semantic_keys(spark, sf_dir), "strict_hash", "abstract_hash")


@query(f"""{D_PATTERNS}, u AS (SELECT id, unnest(['strict', 'abstract']) AS level, unnest([strict_hash, abstract_hash]) AS digest FROM keys)
    SELECT b.id AS bench_id, level, count(*) AS matches, min(c.id) AS first_core_id FROM u b JOIN u c USING (level, digest) WHERE b.id % 40 < 8 AND c.id % 40 >= 8 GROUP BY b.id, level""")
def q127_semantic_matches(spark, sf_dir):
    """For every row of the benchmark and each level of key: how many of the others have it too, and the first of them."""
    pairs = F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"{k}_hash").alias("digest")) for k in ("strict", "abstract")))
    return matched(semantic_keys(spark, sf_dir).select("ids", F.explode(pairs).alias("p")).select("ids", "p.*"), "level", "digest")


RISK = ("typed_ast_hash", "untyped_ast_hash", "composite_hash", "array_access_hash", "assignment_tree_hash")


@query(f"""{D_PATTERNS}, x AS (SELECT b.id AS bench_id, c.id AS core_id, array_to_string([x for x in [{", ".join(f"CASE WHEN b.{k} = c.{k} THEN '{k}' END" for k in RISK)}] if x IS NOT NULL], ',') AS same_components, {", ".join(f"c.{k} AS {k}" for k in RISK)} FROM keys b JOIN keys c USING (abstract_hash) WHERE b.id % 40 < 8 AND c.id % 40 >= 8)
    SELECT bench_id, min(core_id) AS core_id, count(*) AS copies, same_components FROM x WHERE same_components <> '' GROUP BY bench_id, same_components, {", ".join(RISK)}""")
def q128_semantic_high_risk(spark, sf_dir):
    """Pairs of equal abstract keys that agree in one of five digests at least, with those that agree; eight rows of forty stand for the benchmark.

    Rows of the core with one key and one set of digests are one class: its first row stands for its copies.
    """
    keys = semantic_keys(spark, sf_dir)
    classes = counted(keys, "abstract_hash", *RISK).withColumnsRenamed({"first_core_id": "core_id", "matches": "copies"} | {k: f"core_{k}" for k in RISK})
    both = keys.withColumn("bench", benched()).where(F.size("bench") > 0).join(classes.hint("merge"), "abstract_hash")
    same = F.filter(F.array(*(F.when(F.col(k) == F.col(f"core_{k}"), F.lit(k)) for k in RISK)), lambda x: x.isNotNull())
    return both.select("bench", "core_id", "copies", F.array_join(same, ",").alias("same_components")).where("same_components <> ''").select(F.explode("bench").alias("bench_id"), "core_id", "copies", "same_components")
