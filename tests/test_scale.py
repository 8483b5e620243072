"""Plans of queries whose rows are heavy: their work is dealt over tasks, and nothing that grows with the table goes through the driver."""

import contextlib
import hashlib
import io
import random
import tracemalloc

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corvid.functions import code, patterns, trees
from corvid.operators import nesting, overlap, similarity
from corvid.plans import code_catalog, loop_catalog, task_catalog, tree_catalog  # noqa: F401  they register their queries
from corvid.plans.catalog import QUERIES

DEALT = [
    "q112_name_mentions", "q77_semantic_features", "q123_tree_digests", "q124_tree_lists", "q125_tree_digest_matches", "q126_semantic_hashes", "q127_semantic_matches", "q128_semantic_high_risk",
    "q138_function_name_matches", "q139_signature_keys", "q71_normalized_tokens", "q142_prompts", "q107_parameter_types", "q133_function_heads", "q134_loop_kinds", "q72_signature_shape", "q135_vector_loops", "q106_signature_text", "q73_function_names",
]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt(spark, sf, name):
    assert "RoundRobinPartitioning(4)" in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["q112_name_mentions", "q125_tree_digest_matches", "q127_semantic_matches", "q128_semantic_high_risk"])
def test_growing_sides_are_not_broadcast(spark, sf, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["q77_semantic_features", "q126_semantic_hashes"])
def test_rows_are_not_joined_with_themselves(spark, sf, name):
    assert "Join" not in plan(QUERIES[name](spark, sf))


def test_every_slot_hashes_every_shingle(spark, sf):
    """q08's slots against md5 of each shingle with the slot's number before it."""
    text = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 0").first().text
    t = regex.findall(r"[a-z_][\p{L}\p{N}_]*|[0-9]+", text.lower())
    runs = {" ".join(t[k : k + 5]) for k in range(len(t) - 4)}
    got = QUERIES["q08_minhash_portable"](spark, sf).where("dataset = 'bench' AND id = 0").first()
    assert [got[f"m{k}"] for k in range(16)] == [min(int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:15], 16) for s in runs) for k in range(16)]


def test_signatures_take_texts_in_blocks(spark):
    """No batch holds runs of words (five times the text), and a long text is hashed in blocks."""
    texts = pa.array([" ".join(f"w{k}" for k in range(20000)), "a b", "", None])
    tracemalloc.start()
    got = similarity.blake_text_signatures.func(texts).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000
    assert got[2] == got[3] == {"minhash": [0] * 64, "simhash": 0} and any(got[1]["minhash"])


def test_rows_of_nested_texts_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("t", "a", None, 1, "A {", "}"), ("t", "b", "a", 2, "B", None), ("t", "c", "a", 1, "C", None)], "tree string, id string, parent string, place int, head string, tail string")
    got = nesting.assembled(rows.withColumn("head", noted("head")), "tree", "id", "parent", "place", "head", "tail").collect()
    assert [r.text for r in got] == ["A {\n  C\n  B\n}"] and seen.value == 3


def test_trees_of_one_shape_are_read_once(spark, sf, monkeypatch):
    """Rows whose trees differ in texts that no feature shows are one group; pieces of large tables have the same matches."""
    rows = QUERIES["q125_tree_digest_matches"](spark, sf).collect()
    groups = tree_catalog.features_of(spark, sf).select("ids").collect()
    ids = [i for g in groups for i in g.ids]
    assert len(ids) == len(set(ids)) == QUERIES["q124_tree_lists"](spark, sf).count() and len(groups) < len(ids) * 0.8
    monkeypatch.setattr(trees, "TOGETHER", 20)
    assert len(tree_catalog.features_of(spark, sf).select("ids").collect()) > len(groups)
    assert sorted(rows) == sorted(QUERIES["q125_tree_digest_matches"](spark, sf).collect())


def test_shapes_keep_what_features_show(spark):
    """Features of a tree's shape are the tree's, also where something else than a plain name is called or a text is escaped."""
    leaf = lambda kind, text, field="": f'{{"type":"{kind}"{field},"text":"{text}"}}'
    call = lambda called: f'{{"type":"call_expression","children":[{called},{leaf("identifier", "arg")}]}}'
    own = ',"field":"function"'
    member = f'{{"type":"field_expression"{own},"children":[{leaf("identifier", "svobj")},{leaf("field_identifier", "svm")}]}}'
    below = f'{{"type":"identifier"{own},"text":"f","children":[{leaf("identifier", "svx")}]}}'
    texts = [
        call(leaf("identifier", "svadd_f32_x", own)), call(leaf("identifier", "mine", own)), call(member), call(below), call(leaf("identifier", "svq", ', "field" : "function"')), call(leaf("identifier", "svq", ',"field":"funct\\u0069on"')),
        f'{{"type":"block","children":[{leaf("primitive_type", "int")},{leaf("number_literal", "7")},{leaf("number_literal", "+").replace(",", ",\"named\":false,", 1)},{leaf("identifier", "a{")}]}}', '{"type":"number_literal","text":"a\tb"}', "no tree", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, j string").withColumn("shape", trees.shape_text(F.col("j")))
    found = lambda c: sorted(trees.tree_features(rows.select("id", trees.parsed_nodes(c).alias("nodes")), "id", "nodes").collect())
    assert found("j") == found("shape") and len(found("j")) == 7
    shown = {r.id: r.shape for r in rows.collect()}
    assert "svadd_f32_x" in shown[0] and '"arg"' not in shown[0] and "svobj" in shown[2] and "svx" in shown[3] and '"7"' not in shown[6] and '"+"' in shown[6]


def test_codes_of_one_shape_are_read_once(spark, tmp_path, monkeypatch):
    """Facts of code are worked out once for all rows whose code and tree differ in nothing that shows, in pieces too."""
    every = 4 * 9 * 5 * 7 * 11 * 13 * 17  # Keys so far apart have the same statements.
    rows = [(every * k + 2, f"name {k}", f"Brand#{k}", "SMALL" if k % 2 else "MEDIUM", 1 + 6 * (k % 3)) for k in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    seen, bare = spark.sparkContext.accumulator(0), patterns.bare_code

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(patterns, "bare_code", lambda text: bare(noted(text)))
    got = sorted(QUERIES["q126_semantic_hashes"](spark, str(tmp_path)).collect())
    assert [r.id for r in got] == [r[0] for r in rows] and 1 <= seen.value <= 3
    monkeypatch.setattr(trees, "TOGETHER", 30)
    assert sorted(QUERIES["q126_semantic_hashes"](spark, str(tmp_path)).collect()) == got


def test_code_shapes_keep_what_facts_show(spark):
    """Facts of a code's shape are the code's: random codes of words, numbers, marks, comments and literals, cut anywhere, and heads of functions."""
    rng = random.Random(11)
    words = ["name", "x1", "fn123", "_a", "for", "before", "whiles", "while", "if", "else", "svld2_f32", "mysvst1", "svaddv", "gather", "scatters", "PrOduct", "products", "sin", "asin", "sin2", "sqrtf", "std::vector", "std::sort", "a::int", "int", "int32_t", "int32", "const", "void", "éfor", "abcé", "intß", "e\u0301x", "\U00010400a", "sort", "string"]
    numbers = ["2", "22", "0", "17", "2.5", "1.2", "2f", "0x12", "12é", "²", "2_", "1e2"]
    marks = ["*", " * ", "/*", "*/", "//", '"', "'", "\\", '\\"', "\\n", "\n", " ", "(", ")", "{", "}", "[", "]", ",", ";", ".", "->", "+=", "*=", "<<", "&&", "#", "<", ">", "::", "=", "&"]
    head = lambda: f"{rng.choice(['static ', '', '/* c 1 */ ', '#include <v1>' + chr(10)])}{rng.choice(words)} {rng.choice(words)}({', '.join(' '.join(rng.choice([*words, '*', '&', '2']) for _ in range(3)) for _ in range(rng.randrange(4)))}) {{\n"
    made = ["".join(head() if rng.random() < 0.08 else rng.choice(rng.choice([words, words, numbers, marks, marks, [" "]])) for _ in range(rng.randrange(60))) for _ in range(600)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(made)), "id int, code string").withColumn("shape", patterns.code_shape(F.col("code")))
    facts = lambda c: {r.id: r.f for r in rows.select("id", patterns.code_facts(patterns.bare_code(F.col(c)), code.signature(F.col(c))).alias("f")).collect()}
    mine, theirs = facts("shape"), facts("code")
    assert all(mine[k] == theirs[k] for k in range(len(made)))
    assert sum(f.signature.arity > 0 for f in theirs.values() if f.signature) > 100 and len({str(f) for f in theirs.values()}) > 300
    shown = lambda text: spark.createDataFrame([(text,)], "c string").select(patterns.code_shape(F.col("c")).alias("s")).first().s
    assert shown("int fn123(const T a7) { for (i = 12; i < 2; ++i) y[2*i] += 1.5 * sqrtf(svld2(p)); } // gone 9") == "int x(const x x) { for (x = 0; x < 2; ++x) x[2*x] += 0.0 * sqrtf(svld2(x)); } // x 0"


def test_hot_shingles_make_no_pairs_of_rows(spark, monkeypatch):
    """Sets that share a few very common values, some of them mostly such: the same pairs as by a count of all that is shared, though common values join only rows that they make up."""
    monkeypatch.setattr(similarity, "HOT", 6)
    monkeypatch.setattr(similarity, "HOT_PAIRS", 100)
    rng = random.Random(5)
    sets = [(k, sorted({h for h in range(8) if rng.random() < 0.8} | {100 + rng.randrange(60) for _ in range(rng.choice((0, 1, 3, 9, 15)))})) for k in range(120)]
    rows = spark.createDataFrame([r for r in sets if r[1]], "id long, s array<bigint>")
    left, right = rows.where("id % 4 > 0").withColumnRenamed("id", "a"), rows.where("id % 4 = 0").withColumnRenamed("id", "b")
    assert len(similarity.hot_shingles(left, right)) == 6
    got = {(r.a, r.b): (r.shared, r.jaccard, r.containment) for r in similarity.bounded_overlap(left, right, "a", "b", 0.45, 0.75).collect()}
    want = {}
    for i, x in ((i, set(x)) for i, x in sets if i % 4 and x):
        for j, y in ((j, set(y)) for j, y in sets if j % 4 == 0 and y):
            n = len(x & y)
            if n and (n / len(x | y) >= 0.45 or n / min(len(x), len(y)) >= 0.75):
                want[i, j] = (n, n / len(x | y), n / min(len(x), len(y)))
    assert got == want and want


def overlaps(x: dict, y: dict) -> dict:
    """(shared, sizes) of every two sets that reach a bound of q15."""
    n = {(i, j): len(s & t) for i, s in x.items() for j, t in y.items()}
    return {(i, j): (k, len(x[i]), len(y[j])) for (i, j), k in n.items() if k and (k / (len(x[i]) + len(y[j]) - k) >= 0.45 or k / min(len(x[i]), len(y[j])) >= 0.75)}


def test_shared_shingles_make_no_rows(spark, sf):
    """No row for every two pages that share a shingle: nothing is joined or shuffled."""
    steps = plan(QUERIES["q15_semantic_high_risk"](spark, sf))
    assert "Join" not in steps and "Exchange" not in steps


@pytest.mark.parametrize("block", [1 << 22, 150])
def test_overlaps_in_blocks(spark, monkeypatch, block):
    """Sets of all sizes, of common and rare values, parts and near copies of one another, either side the smaller: all pairs and no other, in one block and in many."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "MOST_BITS", 1 << 16)
    rng = random.Random(7)
    value = lambda: rng.randrange(12) if rng.random() < 0.3 else rng.choice((1, -1)) * rng.getrandbits(62)
    sets = [set() if k % 40 == 7 else {value() for _ in range(rng.choice((1, 2, 5, 20, 60)))} for k in range(60)]
    for _ in range(140):
        old = sorted(rng.choice(sets))
        sets.append({v for v in old if rng.random() < rng.choice((0.4, 0.62, 0.75, 1))} | {value() for _ in range(rng.randrange(1 + len(old)))})
    rows = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "id long, s array<bigint>")
    left, right = rows.where("id % 2 = 0").withColumnRenamed("id", "a"), rows.where("id % 2 = 1").select(F.concat(F.lit("b"), "id").alias("b"), "s")
    got = similarity.bounded_overlap(left, right, "a", "b", 0.45, 0.75).collect()
    want = overlaps({k: s for k, s in enumerate(sets) if k % 2 == 0}, {f"b{k}": s for k, s in enumerate(sets) if k % 2})
    assert {(r.a, r.b): (r.shared, r.n_a, r.n_b) for r in got} == want and len(got) == len(want) > 100
    assert len({r.a for r in got if r.n_a < r.n_b}) > 20 and len({r.a for r in got if r.n_a > r.n_b}) > 20
    assert similarity.bounded_overlap(left.limit(0), right, "a", "b", 0.45, 0.75).collect() == similarity.bounded_overlap(left, right.limit(0), "a", "b", 0.45, 0.75).collect() == []


def test_sets_of_hashed_runs(spark, monkeypatch):
    """Runs of five words in their order, words of shorter texts, texts of one key only; a long text is a slice of its own."""
    monkeypatch.setattr(overlap, "SLICE", 40)
    rng = random.Random(3)
    texts = ["", None, "a", "a b a", "a b c d", "a b c d e", "e d c b a", "b a c d e", " ".join("ab"[rng.randrange(2)] for _ in range(200)), *(" ".join(rng.choice("abcde") for _ in range(rng.randrange(30))) for _ in range(60))]
    rows = spark.createDataFrame([(k, t, f"k{k % 7 // 4}") for k, t in enumerate(texts)] + [(900 + k, t, "k0") for k, t in enumerate(texts)], "id long, text string, key string")
    got = similarity.semantic_matches(rows.where("id < 900").withColumnRenamed("id", "a"), rows.where("id >= 900").withColumnRenamed("id", "b"), "a", "b", "key").collect()

    def runs(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {(x,) for x in w}

    want = overlaps({k: runs(t) for k, t in enumerate(texts) if k % 7 < 4}, {900 + k: runs(t) for k, t in enumerate(texts)})
    assert {(r.a, r.b): (r.shared, r.n_a, r.n_b) for r in got} == want and len(got) == len(want) > 40


def test_workers_hold_one_index(monkeypatch):
    """A block that follows another takes its place."""

    class Shared:
        def __init__(self, value):
            self._value = value

        value = property(lambda self: self._value)

    monkeypatch.setattr(overlap, "HELD", {})
    blocks = [Shared({"ids": pa.array([k]), "at": overlap.np.array([0, 2]), "s": overlap.np.array([k, k + 1])}) for k in range(3)]
    for k, shared in enumerate(blocks):
        ids, x = overlap.index_of(str(k), shared, 0.45, 0.75)
        assert ids.to_pylist() == [k] and list(x["keys"]) == [k, k + 1]
        assert list(overlap.HELD) == [str(k)] and not hasattr(shared, "_value") and overlap.index_of(str(k), None, 0.45, 0.75)[1] is x
