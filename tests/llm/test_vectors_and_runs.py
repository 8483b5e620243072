"""Periodic runs, the graph index and vector codes against brute force, with nulls, ties, repeats, long texts, empty tables and clashing columns."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corvid.llm import hnsw, runs, vector_code


def brute_runs(words, least=24, times=3):
    """Every maximal stretch by its smallest period, each stretch tried by each period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                piece = words[i : i + length]
                smaller = any(all(piece[k] == piece[k + p] for k in range(length - p)) for p in range(1, q))
                if not smaller:
                    found[i, q] = length
            i = j
    return sorted((s, q, length) for (s, q), length in found.items())


def collapsed(words, found):
    gone = {k for s, q, length in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repetitive(rng, n):
    out = []
    while len(out) < n:
        unit = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))]
        out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 90)]
    return out[:n]


TEXTS = [None, "", " \t\n", "one", "a " * 24, "a " * 23, "x y z " * 9, "a b " * 12 + "a", ("p q r s t u v w " * 3).strip(), "\x0b".join(["m", "n"] * 20), "é è " * 15, "a b " * 30, "q " * 3000]


def all_texts():
    rng = random.Random(3)
    return TEXTS + [" ".join(repetitive(rng, rng.randrange(1, 250))) for _ in range(60)]


@pytest.mark.parametrize("work", [runs.WORK, 3000, 40])
def test_runs(spark, monkeypatch, work):
    """With all of a text's lags in one task, and cut into few and many ranges."""
    monkeypatch.setattr(runs, "WORK", work)
    texts = all_texts()
    frame = spark.createDataFrame([(k, t, "x", [k]) for k, t in enumerate(texts)] + [(0, TEXTS[4], "x", [0])], "doc_id long, text string, runs string, run_key array<int>").repartition(5)
    got = runs.periodic_runs(frame)
    assert got.columns == ["doc_id", "text", "run_key", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        words = [w.decode() for w in (r.text or "").encode().split()]
        want = brute_runs(words)
        assert [(x.start, x.period, x.length) for x in r.runs] == want
        assert r.collapsed == collapsed(words, want)
    assert sum(bool(r.runs) for r in rows) > 20
    assert runs.periodic_runs(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("least", "times"), [(4, 2), (10, 2), (2, 2), (30, 5)])
def test_runs_of_other_lengths(least, times):
    texts = [t for t in all_texts() if t and len(t) < 2000]
    words, offsets = runs.split_words(pa.array(texts))
    at, found = runs.runs_of(words, offsets, least, times)
    for k, t in enumerate(texts):
        own = found[at == k]
        assert sorted((int(s), int(q), int(n)) for s, n, q in own) == brute_runs(t.encode().split(), least, times)


def test_runs_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = runs.op11_periodic_runs(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    planted = 0
    for r in got:
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            planted += 1
        found = brute_runs(words) if n < 300 else sorted((int(s), int(q), int(k)) for s, k, q in runs.runs_of(*runs.split_words(pa.array([" ".join(words)])), 24, 3)[1])
        best = min(found, key=lambda x: (-Fraction(x[2], x[1]), x[0], x[1]), default=None)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4)
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, q, n in found)) and r.collapsed_sha256 == digest(collapsed(words, found))
    assert planted > 5


def test_planting_leaves_null_ids_and_texts(spark):
    rows = [(None, "a b c"), (6, None), (24, ""), (29, "  ")]
    got = runs.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == rows


def brute_neighbours(rows, asked, k):
    """(query, rank) to (id, cosine), by all cosines."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    rows = {(i, tuple(v)) for i, v in rows if i is not None and ok(v)}
    out = {}
    for i, v in sorted(rows):
        if i in asked:
            q = np.array(v)
            found = sorted((-float((np.array(w) * q).sum() / (np.sqrt((np.array(w) ** 2).sum()) * np.sqrt((q * q).sum()))), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out.setdefault(i, []).append([(j, -s) for s, j in found])
    return out


def found_by(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_neighbours_of_odd_rows(spark):
    """Few rows: all are found, in the order of brute force. Nulls, zeros, other lengths, repeats, ties, a query with fewer candidates than asked."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 0.1]), (11, [0.9, 0.1]), (11, [0.9, 0.1]), (50, [1.0, 2.0, 3.0]), (51, [3.0, 2.0, 1.0]), (100, [7.0]), (12, [0.2, 0.9]), (13, [0.1, -0.9])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, shard string, dim int").repartition(3)
    got = found_by(hnsw.nearest_neighbours(frame, frame.where("vec_id % 50 = 0 OR vec_id IN (2, 6, 7)"), k=5).collect())
    want = brute_neighbours(rows, {0, 50, 100, 2}, 5)
    assert set(got) == {0, 50, 2} and not want[100][0]
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[q][0]]
        assert np.allclose([s for _, s in found], [s for _, s in want[q][0]], atol=1e-14)
    assert hnsw.nearest_neighbours(frame.limit(0), frame).count() == 0


def test_neighbours_over_shards_and_blocks(spark, sf, monkeypatch):
    """Recall and exact scores with several shards and blocks, one vector a third of all rows."""
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 150)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 7)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rows += [(1000 + k, rows[3][1]) for k in range(250)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found_by(hnsw.nearest_neighbours(frame, frame.where("vec_id % 20 = 0")).collect())
    want = brute_neighbours(rows, {i for i, _ in rows if i % 20 == 0}, 5)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        best = dict(want[q][0])
        assert len(found) == 5 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += sum(abs(best.get(i, 9) - s) < 1e-12 for i, s in found)
    assert hits >= 0.95 * 5 * len(got)
    # Copies of a query are its nearest, the smaller ids first.
    assert [i for i, _ in got[1000]] == [3, 1001, 1002, 1003, 1004]


def test_graph_is_connected_and_flat(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(800, 16))
    index = hnsw.build(np.arange(800), vectors)
    assert index["base"].shape == (800, 2 * hnsw.LINKS) and index["base"].dtype == np.int32
    seen, todo = {index["entry"]}, [index["entry"]]
    while todo:
        for n in index["base"][todo.pop()].tolist():
            if n >= 0 and n not in seen:
                seen.add(n)
                todo.append(n)
    assert len(seen) == 800
    level = hnsw.levels(np.arange(100_000))
    assert abs((level > 0).mean() - 1 / hnsw.LINKS) < 0.005 and level.max() >= 3


def test_partial_distances_are_the_nearest_entries():
    rng = np.random.default_rng(2)
    for width, spread in ((1, 3), (4, 3), (4, 400), (9, 50)):
        rows, book = rng.integers(-spread, spread, (500, width)), rng.integers(-spread, spread, (64, width))
        entry, distance = vector_code.nearest_entry(rows, book)
        full = ((rows[:, None] - book[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()
    entry, _ = vector_code.nearest_entry(np.zeros((2, 3), np.int64), np.ones((5, 3), np.int64))
    assert entry.tolist() == [0, 0]


def test_codes_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = vector_code.op13_vector_codes(spark, sf)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({vector_code.SQL['op13_vector_codes']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 50


def brute_codes(rows):
    """Codes by whole distances in plain integers: vec_id to (code, error, label_error), and the books' digest."""
    rows = [(i, [int(np.floor(x * 256)) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(rows[0][1]) // 16
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(16)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            groups = {}
            for _, v, _ in rows:
                groups.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(books[p])]
    found = [[near(x, b) for x, b in zip(cut(v), books, strict=True)] for _, v, _ in rows]
    sums = {}
    for (_, _, l), f in zip(rows, found, strict=True):
        sums[l] = sums.get(l, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[l], digest) for (i, _, l), f in zip(rows, found, strict=True)), key=repr)


@pytest.mark.parametrize("few", [vector_code.FEW_LABELS, 0])
def test_codes_of_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(vector_code, "FEW_LABELS", few)
    rng = random.Random(4)
    rows = [(k if k % 9 else None, [rng.choice([-0.3, 0.1, 0.26, rng.uniform(-1, 1)]) for _ in range(32)], rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(7, rows[7][1], 1), (500, None, 1), (501, [float("nan")] * 32, 2), (502, [None] * 32, None), (-5, rows[3][1], 2), (-5, rows[4][1], None)]
    frame = spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], "vec_id long, embedding array<double>, label int, code string, error string").repartition(4)
    got = sorted(map(tuple, vector_code.compress(frame).collect()), key=repr)
    assert got == brute_codes(rows)
    few_rows = rows[1:6]
    small = spark.createDataFrame(few_rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, vector_code.compress(small).collect()), key=repr) == brute_codes(few_rows)
    assert vector_code.compress(frame.limit(0)).count() == 0


def test_codes_refuse_what_a_long_cannot_hold(spark):
    for vectors in ([[1.0] * 16, [1.0] * 32], [[1.0] * 17], [[1e30] * 16]):
        with pytest.raises(ValueError):
            vector_code.compress(spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int"))
