"""Code functions on hand-computed cases."""

import itertools
import re

from pyspark.sql import functions as F

from corvid.functions import code, features, regions, syntax
from corvid.operators import similarity


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("x")).first().x


def test_tokens(spark):
    toks = lambda t: one(spark, t, code.code_tokens)
    assert toks('a::b(1.5, "x // y") /* c "d" */ <<= \'"\' // end\n@x') == ["a::b", "(", "1.5", ",", "STR", ")", "<<=", "CHR", "x"]
    assert toks("Iechä ñoo 3.x") == ["Iechä", "oo", "3", ".", "x"]
    assert toks(None) == [] and toks("/* open") == ["/", "*", "open"]
    assert one(spark, "if (x1 > 2) return std::max(y, 3.0f);", lambda c: code.normalized(code.code_tokens(c), calls=True)) == ["if", "(", "ID", ">", "NUM", ")", "return", "CALL", "(", "ID", ",", "NUM", "ID", ")", ";"]


def test_signatures(spark):
    text = "#include <x>\nstatic std::vector<int>\n f(const float *a, std::pair<int, long> b, void) {\n}"
    assert one(spark, text, code.signature) == "static std::vector<int> f(const float *a, std::pair<int, long> b, void)"
    assert one(spark, "int f(const float *a, std::map<int, std::pair<int, int>> &b, size_t n)", code.parameters) == ["const float *a", "std::map<int, std::pair<int, int>> &b", "size_t n"]
    assert one(spark, "int f(const float *a, size_t n, T &t)", code.type_shape) == "const float ptr|size_t scalar|ptr"
    assert one(spark, "no signature", code.signature) == ""
    assert one(spark, " extern int  f( float *a ,int b ) ;", code.signature_text) == "int f(float * a,int b)"
    assert one(spark, "int while (x) f (a) g(b)", code.entry_point) == "g"
    assert one(spark, "const float *__restrict a[4]", code.type_text) == "const float*restrict NAME[4]"


def test_parts_outside_brackets(spark):
    assert one(spark, 'a, f(b, c), "x, \\" y", std::pair<int, int> p,, [1, 2],  z ', code.top_level_parts) == ["a", "f(b, c)", '"x, \\" y"', "std::pair<int, int> p", "[1, 2]", "z"]
    assert one(spark, None, code.top_level_parts) == []


def test_preludes(spark):
    text = "#include <a>\n\n#define M(x) \\\n  (x)\nusing T = int;\ntypedef int (*F)(int);\nstruct S {\n int a;\n};\nint g;\nstray line\nmore\n\n#include   <a>\n#define M 2\nusing T = long;"
    items = one(spark, text, code.prelude_items)
    assert items == ["#include <a>", "#define M(x) \\\n  (x)", "using T = int;", "typedef int (*F)(int);", "struct S {\n int a;\n};", "int g;", "stray line\nmore", "#include   <a>", "#define M 2", "using T = long;"]
    merged = spark.createDataFrame([(items,)], "i array<string>").select(code.merged_prelude(F.col("i")).alias("x")).first().x
    assert merged == "\n".join(items[:7])


def test_guarded_blocks(spark):
    text = "a\n#if X\nb\n#if defined(SVE2)\nc\n#if Y\nd\n#endif\n#endif\ne\n#endif\nf\n#endif"
    r = one(spark, text, lambda c: code.without_guarded_blocks(c, F.lit("SVE2|BF16")))
    assert (r.kept.split("\n"), r.removed, r.blocks) == (["a", "#if X", "b", "e", "#endif", "f", "#endif"], 6, 1)


def brute_depth(toks):
    stack, pending, most = [], False, 0
    for t in toks:
        if t in ("for", "while"):
            pending = True
        elif t == "{":
            stack.append(pending)
            most, pending = max(most, sum(stack)) if pending else most, False
        elif t == "}":
            stack, pending = stack[:-1], False
        elif t == ";":
            pending = False
    return most


def test_loop_depth(spark):
    some = ["while (x) { for (auto y : z) { if (a) { } while (b) { } } }", "for (;;) { }", "while (1) ; { }", "} while (a) {", "", "for (a : b) { } for (c : d) { for (e : f) { } }"]
    for t in some:
        assert one(spark, t, lambda c: code.loop_depth(code.code_tokens(c))) == brute_depth(re.findall(r"\w+|[^\w\s]", t)), t
    assert [brute_depth(re.findall(r"\w+|[^\w\s]", t)) for t in some] == [3, 0, 0, 1, 0, 2]


def test_texts(spark):
    assert one(spark, "say:\n```cpp\nint x;\n```\nand\n```\ny\n```", code.without_fences) == "int x;"
    assert one(spark, " plain ", code.without_fences) == "plain"
    assert one(spark, "in /home/me/a/b.cpp:3 and /mnt/x y", code.hidden_paths) == "in b.cpp:3 and x y"
    assert one(spark, "  #include <a>\nx #include\n", code.without_includes) == "x #include\n"
    assert [one(spark, t, code.has_inline_asm) for t in ("__asm__(x)", "asm", "basm", "asm_x")] == [True, True, False, False]
    assert [one(spark, t, regions.is_malformed_line) for t in (None, " ", "a +", "f(", "f(...", "'(' x", 'g("(", \'(\')', "x = \"open (")] == [True, True, True, True, False, False, False, False]


def test_diagnostics(spark):
    rows = [({"error_locations": ["1:2"]}, ["unclassified_structured"]), ({"expected_tokens": [";"], "ambiguous_calls": ["f"]}, ["syntax_closure", "ambiguous_call"]), ({"ambiguous_calls": []}, ["unclassified_structured"]), (None, ["unclassified_structured"])]
    got = spark.createDataFrame([(k, d) for k, (d, _) in enumerate(rows)], "k int, d map<string,array<string>>").select("k", features.diagnostic_classes(F.col("d")).alias("x")).collect()
    assert {r.k: r.x for r in got} == {k: want for k, (_, want) in enumerate(rows)}


def test_region_ladder_takes_the_first_rule(spark):
    def kind(*on):
        flags = [F.lit(f in on).alias(f) for f in regions.REGION_FLAGS]
        return spark.range(1).select(*flags).select(regions.region_kind().alias("k")).first().k

    cases = [((), "pseudocode_loop"), (("array_write",), "store_map"), (("array_write", "branch"), "predicate_store_map"), (("array_write", "indirect"), "indexed_gather_scatter_map"), (("reduction",), "scalar_reduction"), (("reduction", "array_write"), "prefix_or_rolling_output"), (("while_header", "two_pointer"), "two_pointer_swap"), (("while_kind", "reduction"), "pseudocode_control"), (("dependency", "near_index"), "prefix_or_neighbor_dependency"), (("carried_output", "prefix_scan", "branch"), "prefix_scan_predicate"), (("branch", "spec", "selection", "selection_index"), "arg_reduction"), (("array_compound", "two_loops"), "nested_reduction_update"), (("indirect_compound", "array_compound"), "conflict_update")]
    for on, want in cases:
        assert kind(*on) == want


def test_set_similarity_of_empty_sets(spark):
    got = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (2, 3, 6)], "s int, a int, b int").select(similarity.set_jaccard(F.col("s"), F.col("a"), F.col("b")).alias("j"), similarity.set_containment(F.col("s"), F.col("a"), F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (0.0, 0.0), (2 / 7, 2 / 3)]


def test_signature_matches_by_brute_force(spark):
    """Pairs within the bound, over all pairs: copies with a few bits or slots changed, at and beyond the bound."""
    base = [int(x) for x in range(0, 1 << 60, (1 << 60) // 9 + 12345)]
    sims = [(10 * k + j, 20 + j, b ^ sum(1 << (7 * i + j) for i in range(j))) for k, b in enumerate(base) for j in range(7)]
    frame = lambda name: spark.createDataFrame(sims, f"{name} long, n long, simhash long")
    want = {(x, y, bin(p ^ q).count("1")) for (x, m, p), (y, n, q) in itertools.product(sims, sims) if bin(p ^ q).count("1") <= 4 and max(m, n) >= 22}
    got = {tuple(r) for r in similarity.simhash_matches(frame("a"), frame("b"), "a", "b", least=22).collect()}
    assert got == want and len(want) > 60
    sigs = [(k, [v if (v + k) % 16 >= k % 5 else -k for v in range(16)]) for k in range(12)]
    frame = lambda name: spark.createDataFrame(sigs, f"{name} long, sig array<long>")
    want = {(x, y, sum(p == q for p, q in zip(s, t, strict=True)) / 16) for (x, s), (y, t) in itertools.product(sigs, sigs)}
    assert {tuple(r) for r in similarity.minhash_matches(frame("a"), frame("b"), "a", "b", 16, 0.84).collect()} == {w for w in want if w[2] >= 0.84}


def test_loop_specs(spark):
    spec = lambda t: one(spark, t, syntax.loop_spec)
    assert tuple(spec("for (int  i = 0; i < n && a[i]; ++i)")) == ("i", "0", "<", "n", "a[i]", "1")
    assert tuple(spec("for (std::size_t i = n - 1; i >= lo; i -= 4)")) == ("i", "n - 1", ">=", "lo", "", "-4")
    assert tuple(spec("for (i = 0; i > n; s += k, i = i + w)"))[5] == "-w"
    assert [spec(t) for t in ("for (int i = 0; j < n; i++)", "for (i = 0; i < n || b; i++)", "while (x)", "for (i = 0, j = 9; i < j; i++)", "for (auto x : y)", None)] == [None] * 6


def test_trees(spark):
    nodes = one(spark, '{"kind":"A","inner":[{"kind":"B","inner":[{"kind":"C"},{}]},{"kind":"D","isImplicit":true}]}', syntax.tree_nodes)
    assert [(n.kind, n.depth, n.size, n.hidden) for n in nodes] == [("A", 0, 5, False), ("B", 1, 3, False), ("C", 2, 1, False), (None, 2, 1, False), ("D", 1, 1, True)]
    assert [one(spark, t, syntax.tree_nodes) for t in ("{", "", None, "7")] == [None] * 4
    assert [n.kind for n in one(spark, '[{"kind":"X"},{"kind":"Y"}]', syntax.tree_nodes)] == [None, "X", "Y"]
