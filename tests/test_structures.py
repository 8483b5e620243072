"""Trees, loops, sweeps, mentions, blocks, nested texts and Hamming tables against plain Python."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corvid.functions import code, loops, regions, trees
from corvid.operators import mentions, nesting, similarity, sweep
from corvid.plans import loop_catalog

KINDS = ("compound_statement", "for_statement", "while_statement", "if_statement", "assignment_expression", "binary_expression", "subscript_expression", "call_expression", "return_statement", "identifier", "number_literal", "string_literal", "primitive_type", "template_type", "function_definition")
FIELDS = (None, "left", "right", "condition", "initializer", "update", "function")


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([{"type": "identifier", "text": rng.choice(["x", "svld1_s32", "sqrtf"])}, {"type": "number_literal", "text": "1"}, {"type": "x", "named": False, "text": rng.choice(["+", "=", "<<=", "(", ";", "word"])}])
    node = {"type": rng.choice(KINDS), "text": rng.choice(["", "a  b", " t "]), "children": [random_tree(rng, depth - 1) for _ in range(rng.randrange(0, 5))]}
    for c in node["children"]:
        if field := rng.choice(FIELDS):
            c["field"] = field
    return node


def by_recursion(root):
    """Features of a tree, node by node."""
    named = lambda n: n.get("named", True)
    kids = lambda n: n.get("children", [])
    text = lambda n: n.get("text", "")

    def word(n, typed=False, names=False):
        kind = n["type"]
        if kind in trees.NAMES:
            return text(n).strip() if names else "ID"
        if kind in trees.NUMBERS + trees.STRINGS:
            return "NUM" if kind in trees.NUMBERS else "STR"
        return None if "type" not in kind else "TYPE:" + text(n).strip() if typed else "TYPE"

    def tags(n, typed):
        if not named(n):
            return [text(n)] if text(n) in trees.OPERATORS + trees.BRACKETS else []
        w = word(n, typed)
        return [w] * (w != "") if w is not None else [n["type"], *(x for c in kids(n) for x in tags(c, typed)), "/" + n["type"]]

    def expr(n, names=False):
        if n is None:
            return ""
        if not named(n):
            return text(n) if text(n) in trees.OPERATORS else ""
        w = word(n, names=names)
        return w if w is not None else "(" + " ".join([n["type"], *(x for c in kids(n) if (x := expr(c, names)))]) + ")"

    def every(n):
        yield n
        for c in kids(n):
            yield from every(c)

    field = lambda n, f: next((c for c in kids(n) if c.get("field") == f), None)
    got = {k: [] for k in ("loop_nest", "array_access", "assignment_tree", "expression_tree", "call_graph", "returns", "conditions", "writes", "reads", "types")}
    deepest = 0

    def walk(n, depth):
        nonlocal deepest
        kind = n["type"] if named(n) else ""
        if kind in trees.LOOPS:
            depth += 1
            deepest = max(deepest, depth)
            got["loop_nest"].append(f"{kind}:init={expr(field(n, 'initializer'))}:cond={expr(field(n, 'condition'))}:upd={expr(field(n, 'update'))}")
        if kind == "if_statement":
            got["conditions"].append(expr(field(n, "condition")))
        if kind == "assignment_expression":
            left, right = expr(field(n, "left")), field(n, "right")
            op = next((text(c) for c in kids(n) if not named(c) and text(c) in code.ASSIGN), "=")
            got["assignment_tree"].append(left + op + expr(right))
            got["writes"].append(left)
            got["reads"] += [expr(x) for x in every(right) if x["type"] == "subscript_expression"] if right else []
        if kind == "subscript_expression":
            got["array_access"].append(expr(n))
        if kind == "call_expression":
            c = expr(field(n, "function"), names=True)
            got["call_graph"].append(re.sub(r"_[suf](8|16|32|64).*", "_T", c) if "sv" in c else "math:" + c if any(m in c for m in code.MATH) else "call")
        if kind == "return_statement":
            got["returns"].append(expr(n))
        if kind in trees.EXPRESSIONS:
            got["expression_tree"].append(expr(n))
        if "type" in kind and text(n).strip():
            got["types"].append(" ".join(text(n).split()))
        for c in kids(n):
            walk(c, depth)

    functions = [n for n in every(root) if n["type"] == "function_definition"]
    typed, untyped = [], []
    for f in functions or [root]:
        typed += tags(f, True)
        untyped += tags(f, False)
        walk(f, 0)
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    bars = lambda k: "|".join(sorted(got[k]))
    digests = {"typed_ast": sha(typed), "untyped_ast": sha(untyped), **{k: sha(sorted(got[k])) for k in trees.DIGESTS[2:7]}}
    digests["composite"] = sha(["loops:" + bars("loop_nest"), "arrays:" + bars("array_access"), "assign:" + bars("assignment_tree"), "calls:" + bars("call_graph"), "returns:" + bars("returns")])
    lists = {k: (sorted(got[k]) if k == "loop_nest" else sorted(set(got[k])))[:most] for k, most in trees.LISTS.items()}
    return {"functions": len(functions), "max_loop_depth": deepest, **{f"{k}_hash": v for k, v in digests.items()}, **lists}


def test_tree_features_by_recursion(spark):
    rng = random.Random(8)
    made = [random_tree(rng, rng.randrange(1, 6)) for _ in range(60)]
    made.append({"type": "translation_unit", "children": [{"type": "function_definition", "children": [random_tree(rng, 5), {"type": "function_definition", "children": [random_tree(rng, 4)]}]} for _ in range(2)]})
    rows = [(k, json.dumps(t)) for k, t in enumerate(made)] + [(900, "no tree"), (901, None), (902, "[1]")]
    nodes = spark.createDataFrame(rows, "id long, j string").select("id", trees.parsed_nodes("j").alias("nodes"))
    got = {r.id: r.asDict() for r in trees.tree_features(nodes, "id", "nodes").collect()}
    assert set(got) == set(range(len(made)))
    for k, t in enumerate(made):
        want = by_recursion(t)
        assert {x: got[k][x] for x in want} == want, t


def test_every_kind_of_loop_is_reached_and_depends_on_its_record(spark):
    """The kinds written by hand, and other kinds where one thing in the record is another."""
    text = lambda r: r.replace("@v", "i").replace("@n", "7")
    kinds = lambda rs: [r.kind for r in loops.loop_flags(spark.createDataFrame([(k, text(r)) for k, r in enumerate(rs)], "id int, j string").select("id", F.from_json("j", loops.RECORD).alias("r")).select("id", "r.*"), "id").where("nth = 0").select("id", regions.region_kind().alias("kind")).orderBy("id").collect()]
    assert {k for _, k, _, _ in loop_catalog.RECORDS} == {k for k, _ in regions.REGIONS} and kinds([r for r, *_ in loop_catalog.RECORDS]) == [k for _, k, _, _ in loop_catalog.RECORDS]
    item, record, head = loop_catalog.item, loop_catalog.record, loop_catalog.HEAD
    other = [
        (record(head, [item(200, "a[@v] = b[@v]", "a[@v]", "b[@v]")]), "store_map"), (record(head, [item(200, "a[@v] = a[@v]", "a[@v]", "a[@v]")]), "store_map"),
        (record(head, [item(200, "a[@v] = a[(@v)]", "a[@v]", "a[(@v)]")]), "store_map"), (record(head, [item(200, "a[@v] = a[@v+1]", "a[@v]", "a[@v+1]")]), "prefix_or_neighbor_dependency"),
        (record(head, [item(950, "a[@v] = a[@v+1]", "a[@v]", "a[@v+1]")]), "pseudocode_loop"), (record(head, [item(200, "s += 1"), item(300, "a[@v] = ss", "a[@v]")]), "prefix_or_rolling_output"),
        (json.dumps({"loops": [{"begin": 1, "end": 9}]}), "pseudocode_loop"),
    ]
    assert kinds([r for r, _ in other]) == [k for _, k in other]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_sweep_over_any_number_of_ranges(spark, parts):
    """One key with half of all rows, intervals that overlap or last for ever, equal places and nulls."""
    rng = random.Random(parts)
    key = lambda: rng.choice(["hot", "hot", "a", "b"])
    intervals = [(k, key(), b := rng.randrange(300), b + rng.choice([0, 3, 20, 90, 400])) for k in range(160)] + [(900, "a", 5, 2), (901, None, 1, 2), (902, "a", None, 2)]
    points = [(k, key(), rng.randrange(-5, 320)) for k in range(300)] + [(999, None, 5)]
    got = sweep.open_intervals(spark.createDataFrame(intervals, "id int, k string, b int, e int"), spark.createDataFrame(points, "p int, k string, at int"), "k", "b", "e", "id", "at", "p", parts)
    want = set()
    for p, k, at in points:
        held = sorted((-b, e, -i) for i, c, b, e in intervals if c == k and k is not None and None not in (b, e) and b <= at <= e)
        want |= {(p, -i, level) for level, (_, _, i) in enumerate(held)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_mentions(spark, monkeypatch):
    """Overlapping and nested terms, word bounds, repeats, nulls; the same in many blocks."""
    texts = ["abcabc abc_ abc", "aaaa", None, "", "x.y éabc abc", "a.b ab"]
    terms = ["abc", "abc", "bca", "aa", "a.b", "y", "", None, "é", "none"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(2)
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    for words in (False, True):
        want = set()
        for k, t in enumerate(texts):
            for term in {x for x in terms if x}:
                edge = lambda c: r"(?<!\w)" if re.match(r"\w", c) else ""
                pattern = (edge(term[0]) + re.escape(term) + (r"(?!\w)" if re.match(r"\w", term[-1]) else "")) if words else re.escape(term)
                n = len(re.findall(f"(?={pattern})" if not words else f"{edge(term[0])}(?={re.escape(term)}{'(?!' + chr(92) + 'w)' if re.match(r'\w', term[-1]) else ''})", t or ""))
                if n:
                    want.add((k, term, n))
        for most in (1 << 20, 4):
            assert {tuple(r) for r in mentions.mentions(docs, frame, "text", "term", "doc_id", words, most).collect()} == want
    assert mentions.mentions(docs, frame.limit(0), "text", "term", "doc_id").count() == 0


def test_a_hundred_thousand_terms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    terms = spark.range(100_000).select(F.concat(F.lit("term"), "id").alias("term")).unionByName(spark.createDataFrame([("tion",)], "term string"))
    got = mentions.mentions(docs, terms, "text", "term", "doc_id").collect()
    assert {r.term for r in got} == {"tion"} and len(got) == docs.where("contains(text, 'tion')").count()


def test_blocks_are_those_of_the_function_on_texts(spark):
    rng = random.Random(6)
    files = ["\n".join(rng.choice(["#if X", "#if defined(SVE2)", "  #ifdef BF16", "#endif", " #endif", "code", "SVE2 code"]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    rows = [(f, n, line) for f, text in enumerate(files) for n, line in enumerate(text.split("\n"), 1)]
    lines = spark.createDataFrame(rows, "file int, line int, value string")
    bare = F.ltrim("value")
    got = nesting.without_blocks(lines, "file", "line", F.startswith(bare, F.lit("#if")), F.startswith(bare, F.lit("#endif")), F.rlike("value", F.lit("SVE2|BF16"))).collect()
    texts = spark.createDataFrame([(f, t) for f, t in enumerate(files)], "file int, text string").select("file", code.without_guarded_blocks("text", F.lit("SVE2|BF16")).alias("x")).collect()
    for r in texts:
        own = sorted((x for x in got if x.file == r.file), key=lambda x: x.line)
        assert ("\n".join(x.value for x in own if not x.gone), sum(x.gone for x in own), sum(x.cut for x in own)) == tuple(r.x)


def test_matched_blocks(spark):
    text = ["}", "a", "{", "b", "{", "c", "}", "d", "}", "}", "e", "{"]
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(text)], "file string, line int, v string")
    got = {r.line: (r.block_depth, r.block_opener) for r in nesting.matched_blocks(lines, "file", "line", F.col("v") == "{", F.col("v") == "}").collect()}
    assert [got[k] for k in range(12)] == [(0, None), (0, None), (1, 2), (1, 2), (2, 4), (2, 4), (2, 4), (1, 2), (1, 2), (0, None), (0, None), (1, 11)]


def test_nested_rows_are_put_together(spark):
    rows = [("t", "a", None, 2, "for a {", "}"), ("t", "b", "a", 1, "b;", None), ("t", "c", "a", 0, "for c {", "}"), ("t", "d", "c", 0, "for d {", "}"), ("t", "e", "d", 0, "e;", None), ("t", "z", None, 1, "z;", None), ("t", "x", "gone", 1, "x;", None), ("u", "a", None, 1, "alone", None)]
    got = nesting.assembled(spark.createDataFrame(rows, "tree string, id string, parent string, place int, head string, tail string"), "tree", "id", "parent", "place", "head", "tail").collect()
    assert {r.tree: r.text for r in got} == {"t": "z;\nfor a {\n  for c {\n    for d {\n      e;\n    }\n  }\n  b;\n}", "u": "alone"}


@pytest.mark.parametrize(("most", "spare"), [(4, 2), (4, 1), (2, 3)])
def test_hamming_tables_find_all_near_hashes(spark, most, spare):
    """Planted neighbours at every distance; each pair once, copies expanded, few candidates by chance."""
    rng = random.Random(most)
    items = [(k, rng.randrange(20, 40), rng.getrandbits(60)) for k in range(40)]
    docs = [(k, rng.randrange(1, 40), rng.getrandbits(60)) for k in range(1500)]
    for k, (_, _, h) in enumerate(items):
        for d in range(6):
            near = h
            for bit in rng.sample(range(60), d):
                near ^= 1 << bit
            docs += [(2000 + 10 * k + d, 25, near)] * (3 if d == 1 else 1)
    left, right = spark.createDataFrame(docs, "doc_id long, n long, simhash long"), spark.createDataFrame(items, "item_id long, n long, simhash long")
    got = sorted(tuple(r) for r in similarity.simhash_matches(left, right, "doc_id", "item_id", most, spare=spare).collect())
    want = sorted((d, i, (x ^ y).bit_count()) for d, n, x in docs for i, m, y in items if (x ^ y).bit_count() <= most and max(n, m) >= 20)
    assert got == want and len(want) >= 40 * most
    pairs = similarity.simhash_candidates(left, right, most, spare)
    assert pairs.count() == pairs.distinct().count() < len(docs) * len(items) / 20


def test_minhash_agreement_follows_jaccard(spark):
    sets = [(0, [f"s{k}" for k in range(400)]), (1, [f"s{k}" for k in range(200, 600)]), (2, [f"s{k}" for k in range(400)]), (3, [f"t{k}" for k in range(400)])]
    rows = spark.createDataFrame(sets, "id long, s array<string>").select("id", F.explode("s").alias("s"))
    sig = {r.id: r.sig for r in similarity.portable_minhash(rows, "id", 256).collect()}
    share = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / 256
    assert share(0, 2) == 1 and share(0, 3) == 0 and abs(share(0, 1) - 1 / 3) < 0.1


def test_heads_of_functions(spark):
    text = "#include <m>\n// g() {\nstatic T f(int a, std::map<int, std::vector<std::pair<int,int>>> m, int (*cb)(int, int), int d = h(1, 2)) {\n  for (;;) { }\n  if (x) { y(); }\n}\nvoid  last (void)\n{ }\nchar *p(int) { }\nint decl(int);\nS::S(int a) { }\n"
    heads = spark.createDataFrame([(text,)], "c string").select(code.function_heads(F.col("c")).alias("h")).first().h
    first = "static T f(int a, std::map<int, std::vector<std::pair<int,int>>> m, int (*cb)(int, int), int d = h(1, 2))"
    assert [(h.name, h.head) for h in heads] == [("f", first), ("last", "void last (void)"), ("p", None)]
    pick = lambda c: spark.createDataFrame([(first,)], "s string").select(c(F.col("s")).alias("x")).first().x
    assert pick(code.parameters) == ["int a", "std::map<int, std::vector<std::pair<int,int>>> m", "int (*cb)(int, int)", "int d = h(1, 2)"]
    assert [spark.createDataFrame([(p,)], "p string").select(code.type_text(F.col("p")).alias("t")).first().t for p in ("const float *__restrict  a", "float b [ 3 ]", "T && v", "int (*cb)(int)", "")] == ["const float*restrict NAME", "float NAME[ 3 ]", "T&&NAME", "int (*cb)(int)", ""]
