"""Each operator against a brute-force version, on small tables with nulls, ties, long texts and clashing columns."""

import hashlib
import heapq
import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvid.llm import components, decontaminate, exact_dedup, language_id, lm_score, mixing, ngram_join, pii, quality, sharding, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, keep string, node int, id string, rows int"
ODD = [
    (1, "same text here", "en", "s", "x", 1, "q", 0), (2, "same text here", "en", "s", None, 2, "q", 1), (2, "same text here", "en", "s", None, 2, "q", 1),
    (3, None, None, None, "x", 3, None, None), (4, "", "en", "s", "x", 4, "q", 1), (5, "   \n\t", "de", None, "x", 5, "q", 2),
    (None, "same text here", "en", "s", "x", 6, "q", 3), (6, "one", "en", "s", "x", 7, "q", 4), (7, "wort " * 30_000, "de", "s", "x", 8, "q", 5), (8, "1234 5678", "de", "t", "x", 9, "q", 6),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_exact_dedup(spark, odd, none):
    for keep, best in (("smallest", min), ("largest", max)):
        got = exact_dedup.exact_duplicates(odd, keep=keep).collect()
        assert len(got) == len(ODD)
        groups = {}
        for r in ODD:
            groups.setdefault(r[1] or "", []).append(r[0])
        want = sorted(((i, best((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=repr)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_exact_dedup_of_extreme_identifiers(spark):
    ids = [-(2**63), 2**63 - 1, 0, None]
    frame = spark.createDataFrame([(i, "same") for i in ids], "doc_id long, text string")
    for keep, best in (("smallest", -(2**63)), ("largest", 2**63 - 1)):
        assert {r.keep_id for r in exact_dedup.exact_duplicates(frame, keep=keep).collect()} == {best}


def test_tree_merge_over_any_number_of_nodes(spark):
    rng = random.Random(5)
    rows = [(f"{rng.randrange(40):06x}" * 2, 1, 2, rng.choice([None, rng.randrange(1000)])) for _ in range(400)]
    want = {}
    for d, _, _, i in rows:
        want.setdefault(d, []).append(i)
    frame = spark.createDataFrame(rows, "digest string, bytes long, crc long, id long").repartition(7)
    for nodes in (1, 2, 8, 32):
        got = exact_dedup.digest_classes(frame, nodes=nodes)
        assert got.rdd.getNumPartitions() == nodes
        assert sorted((r.digest, r.keep, r.rows) for r in got.collect()) == sorted((d, min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in want.items())
    assert [exact_dedup.tree_nodes(n) for n in (0, 1, 1 << 15, (1 << 15) + 1, 10**6, 10**15)] == [1, 1, 1, 2, 32, 1 << 13]


def test_exact_dedup_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {tuple(r) for r in c.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.SQL['op9_exact_dedup']})").fetchall()}
    assert {tuple(r) for r in exact_dedup.op9_exact_dedup(spark, sf).collect()} == want


def shingle_sets(rows, width):
    out = {}
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute_components(rows, width, percent):
    sets = shingle_sets(rows, width)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join(spark, docs, width, percent):
    rng = random.Random(width)
    rows = [(r.doc_id, r.text[:3000]) for r in docs.limit(120).collect()]
    base = rows[7][1].split(" ")
    for k in range(60):  # a large group of near copies on both sides of the threshold
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(999)}"
        rows.append((1000 + k, " ".join(copy)))
    rows += [(2000, "a b"), (2001, "A  B"), (2002, "b a"), (2003, ""), (2004, None), (2005, " "), (2006, "a")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=width, percent=percent)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, width, percent)


def test_jaccard_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
    rows = [(k, " ".join(f"w{j}" for j in range(100) if j != k)) for k in range(40)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=94)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, 3, 94)


def test_jaccard_strays(spark, monkeypatch):
    """Windows that slide along one text link to their neighbours only, most of them in other pieces than the center's links reach."""
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
    rows = [(k, " ".join(f"w{j}" for j in range(k, k + 100))) for k in range(60)]
    rows += [(100 + k, " ".join(f"w{j}" for j in range(k, k + 100) if j % 50)) for k in range(60)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=92)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, 3, 92)


def test_jaccard_odd_rows(odd, none):
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id not in (1, 2))
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.one_of_each(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8]


def test_memberships_do_not_depend_on_batches():
    rows = sorted((tok, 100 + (7 * k) % 15, k, -k) for tok, size in enumerate((1, 2, 2, 1, 3, 5, 2)) for k in range(10 * tok, 10 * tok + size))

    def members(cuts):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in range(4)], names=["token", "n", "s1", "s2"]) for part in parts]
        return [tuple(r.values()) for b in ngram_join.memberships(90)(iter(batches)) for r in b.to_pylist()]

    whole = []
    token, centers, last = None, [], None
    for r in rows:
        token, centers, last = ngram_join.step(whole, *r, token, centers, last, 90)
    assert {m[2] for m in whole} == {r[2] for r in rows if sum(x[0] == r[0] for x in rows) > 1}
    for a in range(len(rows) + 1):
        for b in range(a, len(rows) + 1):
            assert members([a, b]) == whole
    assert members(range(1, len(rows))) == whole


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(k, 0) for k in range(1, 51)} | {(200, 100), (300, 100)}


def test_pour_is_the_greedy_schedule():
    rng = random.Random(4)
    for _ in range(200):
        loads = [rng.randrange(1000) for _ in range(rng.randrange(1, 9))]
        size, count = rng.randrange(1, 60), rng.randrange(0, 300)
        heap = [(load, k) for k, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, k = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, k))
        mine = list(loads)
        assert sum(sharding.pour(mine, size, count)) == count
        assert sorted(mine) == sorted(load for load, _ in heap)


@pytest.mark.parametrize(("shards", "part_rows"), [(1, 1 << 16), (5, 1 << 16), (5, 3), (24, 8)])
def test_shards_are_the_longest_processing_time_schedule(spark, monkeypatch, shards, part_rows):
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    rng = random.Random(shards)
    sizes = [rng.choice([rng.randrange(9, 40), rng.randrange(2000, 2100), rng.randrange(9, 90_000)]) for _ in range(300)] + [1500] * 70 + [10**7]
    got = sharding.shard_groups(spark.createDataFrame([(str(k).encode(), n) for k, n in enumerate(sizes)], "key binary, bytes long").repartition(3), shards)
    mine = [0] * shards
    rows = got.collect()
    assert sorted(int(r.key) for r in rows) == list(range(len(sizes)))
    for r in rows:
        mine[r.shard] += sizes[int(r.key)]
    heap = [(0, k) for k in range(shards)]
    for n in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, k))
    assert sorted(mine) == sorted(load for load, _ in heap)


def test_slots_are_gapless_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 7)
    slots = {}
    for r in sharding.shard(docs, 3).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(odd, none, docs):
    for frame, n in ((odd, len(ODD)), (docs, docs.count())):
        got = sharding.shard(frame, 5).collect()
        assert len(got) == n
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    loads = [0] * 5
    for r in got:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        assert by_text.setdefault(t, r.shard) == r.shard
        loads[r.shard] += r.size
    assert max(loads) - min(loads) < 0.02 * max(loads)
    assert sharding.shard(none).count() == 0


def test_rake_and_calibrate():
    rng = np.random.default_rng(3)
    cells = [(a, b, c, float(rng.integers(50, 500))) for a in "xyz" for b in "uv" for c in range(3)]
    targets = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"u": 0.6, "v": 0.4}, {0: 0.2, 1: 0.3, 2: 0.5}]
    fitted = mixing.rake(cells, targets)
    for k, t in enumerate(targets):
        for v, share in t.items():
            assert abs(sum(f for c, f in zip(cells, fitted, strict=True) if c[k] == v) - share) < 1e-6
    totals = np.array([c[-1] for c in cells])
    p = mixing.calibrate(fitted / totals, totals, 0.5)
    assert abs((p * totals).sum() / totals.sum() - 0.5) < 1e-9
    assert p.max() <= 1


def test_mixing(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD)
    assert {r.mix_tokens for r in got if r.doc_id == 7} == {30_000}
    assert {(r.mix_tokens, r.mix_weight, r.mix_probability) for r in got if r.doc_id in (3, 4, 5)} == {(0, 1.0, 0.5)}
    assert mixing.mix(none).count() == 0


NEW = ["mix_tokens", "mix_topic", "mix_weight", "mix_probability", "mix_kept"]


def fates(df):
    return {r.doc_id: tuple(r[c] for c in NEW) for r in df.select("doc_id", *NEW).collect()}


def test_mixing_with_clashing_columns(docs):
    plain = fates(mixing.mix(docs))
    clash = docs.withColumns({c: F.lit("x") for c in ("mix_a", "mix_lost", "mix_u", "mix_own", "mix_profile", "mix_kept", "a", "weight")})
    for keep_text in (True, False):
        got = mixing.mix(clash, keep_text=keep_text)
        assert fates(got) == plain
        assert {r.mix_a + r.mix_lost + r.mix_u + r.mix_own + r.mix_profile + r.a + r.weight for r in got.collect()} == {"x" * 7}
        assert ("text" in got.columns) == keep_text


def test_mixing_keeps_by_brute_force(spark, docs):
    """Topics, cells, weights and kept rows against plain Python; the expected share is met."""
    rows = docs.collect()
    got = fates(mixing.mix(docs, share=0.4))
    tokens = {r.doc_id: len(r.text.encode().split()) for r in rows}
    assert {k: v[0] for k, v in got.items()} == tokens
    cells = {}
    for r in rows:
        key = (r.source, r.lang, got[r.doc_id][1])
        cells[key] = cells.get(key, 0) + tokens[r.doc_id]
    full = [(*k, n) for k, n in cells.items() if n]
    want = [mixing.tempered(full, k, p) for k, p in enumerate((0.5, 0.7, 0.5))]
    fitted = mixing.rake(full, want)
    whole = sum(cells.values())
    for (*key, n), f in zip(full, fitted, strict=True):
        for r in rows:
            if (r.source, r.lang, got[r.doc_id][1]) == tuple(key):
                assert abs(got[r.doc_id][2] - f / (n / whole)) < 1e-6
    assert abs(sum(tokens[k] * v[3] for k, v in got.items()) - 0.4 * whole) < 1e-6 * whole
    u = {r.doc_id: r.u for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")), F.lit(1 << 40)) / float(1 << 40)).alias("u")).collect()}
    assert all(v[4] == (u[k] < v[3]) for k, v in got.items())


def test_topics_by_brute_force(docs):
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    tokens, profile = mixing.profiles(pa.array(texts))
    centers = None
    for _ in range(mixing.ROUNDS):
        near = mixing.topics_of(profile, tokens, centers)
        sums = np.stack([profile[near == k].sum(0, dtype=np.int64) for k in range(mixing.TOPICS)]).astype(float)
        centers = np.rint(1e6 * sums / np.maximum(1.0, np.sqrt((sums * sums).sum(1, keepdims=True)))).astype(np.int64)
    want = [max(range(mixing.TOPICS), key=lambda k: (sum(int(x) * int(c) for x, c in zip(p, centers[k], strict=True)), -k)) if p.any() else -1 if n else -2 for p, n in zip(profile, tokens, strict=True)]
    for parts in (1, 7):
        got = mixing.mix(docs.repartition(parts)).orderBy("doc_id").collect()
        assert [r.mix_topic for r in got] == want
    assert len(set(want)) > 3


def test_mixing_by_a_topic_column(docs):
    got = mixing.mix(docs.withColumn("subject", F.concat(F.lit("t"), F.col("doc_id") % 3)), topic="subject").collect()
    assert {r.mix_topic for r in got} == {"t0", "t1", "t2"} and all(r.mix_topic == r.subject for r in got)


def test_any_number_of_cells_is_raked(spark, odd, monkeypatch):
    rng = random.Random(2)
    cells = [(a, b, c, rng.choice([0, rng.randrange(1, 500)])) for a in ("x", "y", None) for b in ("u", "v") for c in range(3)]
    frame = spark.createDataFrame(cells, "a string, b string, c int, n long")
    for targets in (None, [{"x": 3.0, None: 1.0, "z": 9.0}, {"u": 0.6, "v": 0.4}, {0: 0.2, 1: 0.3, 2: 0.5}]):
        want = {c[:3]: c[3:] for c in mixing.cell_plan(cells, 0.4, (0.5, 0.7, 0.5), targets, rounds=2)}
        got = {tuple(r)[:3]: tuple(r)[3:] for r in mixing.spark_cell_plan(frame, 0.4, (0.5, 0.7, 0.5), targets, rounds=2).collect()}
        assert got.keys() == want.keys()
        assert all(abs(x - y) < 1e-6 for k in want for x, y in zip(got[k], want[k], strict=True))
    table = odd.where("doc_id is not null")
    want = fates(mixing.mix(table, rounds=1))
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 2)
    got = fates(mixing.mix(table, rounds=1))
    assert all(got[k][:2] == v[:2] and abs(got[k][2] - v[2]) < 1e-6 and abs(got[k][3] - v[3]) < 1e-6 for k, v in want.items())


def brute_urls(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([k for k in (tail.find(c) for c in "?#") if k >= 0], default=len(tail))]
    best = None
    for rule in url_filter.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_url_filter(spark, sf):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "x://example.com/en/8", "x://bexample.com/en/7", "a://b.org/es/1", "a://org/es/", "a://É.net/de/3", "a://example.net/de/81?", "a://u@h:1/p#f?q", "a://h?x/y", "a://com/en/\n2", "z" * 50_000 + "://h/p"]
    urls += [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = url_filter.filter_urls(spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id int, url string, rule string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule) == brute_urls(urls[r.page_id])
        assert r.verdict == (url_filter.RULES[r.rule] if r.rule else ("block" if r.probability >= 0.5 else "allow"))


def test_url_filter_on_odd_tables(spark):
    frame = spark.createDataFrame([("http://a.com/en/1",)], "url string")
    clash = frame.withColumns({c: F.lit("x") for c in ("rule_verdict", "url_grams", "host", "probability", "verdict")})
    r = url_filter.filter_urls(clash).first()
    assert (r.rule_verdict, r.url_grams, r.host, r.verdict) == ("x", "x", "a.com", "block")
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


def test_url_probability_by_hand(spark):
    """The model's score of every url against plain Python over the same hashed n-grams."""
    weights, bias = url_filter.fit(spark)
    urls = ["http://Cheap-Pills.example/buy?x", "https://docs.library.example/en/tutorial", "x", None]
    for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules={}, model=(weights, bias)).collect():
        host, path, _ = brute_urls(r.url)
        hashes = [zlib.crc32((tag + t[k : k + n]).encode()) % url_filter.BUCKETS for tag, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in url_filter.SIZES for k in range(len(t) - n + 1)]
        z = sum(weights[h] for h in hashes) / max(1, len(hashes)) ** 0.5 + bias
        assert abs(r.probability - 1 / (1 + np.exp(-z))) < 1e-9 and r.verdict == ("block" if r.probability >= 0.5 else "allow")


def test_url_model_learns_its_table(spark):
    frame = spark.createDataFrame(url_filter.LABELLED + [("http://free-porn-casino.example/xxx/bonus", 1), ("https://docs.garden.example/guide/tutorial", 0)], "url string, y int")
    got = url_filter.filter_urls(frame, rules={}).collect()
    assert all((r.verdict == "block") == (r.y == 1) for r in got)


def test_decontamination(spark, docs, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng, rows, want = random.Random(1), [], set()
    for k, (item, t) in enumerate(items):
        copy = list(t)
        for _ in range(len(t) // 40):
            copy[rng.randrange(len(copy))] = "#"
        rows.append((k, "Some words before. " + "".join(c if c == "ß" else c.upper() for c in copy).replace(" ", "\n  ") + " and after"))
        want.add((k, item))
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "tiny"), (903, " TINY"), (904, items[0][1])], "item_id long, text string")
    frame = spark.createDataFrame([*rows, (500, None), (501, ""), (502, " Tiny "), (503, "not  tiny, no"), (504, "tinyx xtiny"), (505, " ")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(frame, bench).collect()}
    assert want | {(d, i) for d in (502, 503) for i in (902, 903)} | {(0, 904)} <= got
    assert not {d for d, _ in got} & {500, 501, 504, 505}
    clean = spark.createDataFrame([(r.doc_id, r.text[::-1]) for r in docs.limit(50).collect()], "doc_id long, text string")
    assert decontaminate.find_contamination(clean, bench).count() == 0
    assert {r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()} == {500, 501, 504, 505}
    clash = decontaminate.decontaminate(frame.withColumns({"contaminated": F.lit("x"), "Contaminated_": F.lit("y")}), bench)
    assert {tuple(r)[0] for r in clash.collect()} == {500, 501, 504, 505} and clash.columns == ["doc_id", "text", "contaminated", "Contaminated_"]
    assert decontaminate.find_contamination(frame, bench.limit(0)).count() == 0


def test_decontamination_against_all_exact_passages(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    got = decontaminate.op1_decontamination(spark, sf).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}
    text, item = {d.doc_id: d.text for d in docs}, {b.item_id: b.text for b in items}
    for r in got:
        if r.edits == 0:
            assert " ".join(text[r.doc_id][r.start : r.stop].lower().split()) in " ".join(item[r.item_id].lower().split())


def least_edits(text: bytes, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each window, the edits of its best occurrence anywhere in the text, by the whole matrix."""
    n, width = windows.shape
    ramp = np.arange(width + 1)
    column = np.tile(ramp, (n, 1))
    best = column[np.arange(n), sizes].copy()
    for c in text:
        new = np.zeros_like(column)
        new[:, 1:] = np.minimum(column[:, :-1] + (windows != c), column[:, 1:] + 1)
        column = np.minimum.accumulate(new - ramp, axis=1) + ramp
        best = np.minimum(best, column[np.arange(n), sizes])
    return best


@pytest.mark.parametrize("pairs", [1 << 19, 300])
def test_decontamination_finds_all_and_only_windows_within_the_budget(spark, sf, monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12] + [(99, "abcabcabcabd" * 5), (98, "ein kurzes stück")]
    index = decontaminate.build_index(items)
    texts = []
    for _ in range(200):
        t = rng.choice(items)[1]
        at, n = rng.randrange(max(1, len(t) - 60)), rng.randrange(20, 260)
        part = list(t[at : at + n])
        for _ in range(rng.randrange(0, 1 + len(part) // 12)):
            part[rng.randrange(len(part))] = rng.choice(["", "x", "yz", " "])
        texts.append("".join(rng.choice("abcde ") for _ in range(rng.randrange(80))) + "".join(part) * rng.choice([1, 1, 2]) + "abcabc" * rng.randrange(20))
    got = {}
    for r, item, edits, _, _ in decontaminate.search(index, pa.array(texts)):
        got[r, item] = edits
    want = {}
    for r, t in enumerate(texts):
        b, _, _ = decontaminate.normalize(*decontaminate.flat(pa.array([t])))
        best = least_edits(b.tobytes(), index["windows"], index["size"])
        for w in np.flatnonzero(best <= index["budget"]):
            for item in index["owners"][w]:
                want[r, item] = min(want.get((r, item), 99), int(best[w]))
    assert got == want and len(want) > 20


def test_decontamination_of_long_repetitive_text():
    """1 MB of one letter against items of that letter: bounded memory, and the items found."""
    import resource

    index = decontaminate.build_index([(k, "a" * 5000) for k in range(50)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = decontaminate.search(index, pa.array(["a" * (1 << 20), "ab" * 1000]))
    assert {x[1] for x in got if x[0] == 0} == set(range(50)) and all(x[2] == 0 for x in got if x[0] == 0)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_alignment_is_the_edit_distance():
    rng = random.Random(8)
    for _ in range(40):
        w = "".join(rng.choice("abcd") for _ in range(100))
        t = list("xyz" * 9 + w + "xyz" * 9)
        for _ in range(rng.randrange(7)):
            k = rng.randrange(30, 120)
            t[k : k + rng.randrange(2)] = rng.choice(["", "q", "b"])
        t = "".join(t)
        row = [0] * (len(t) + 1)
        for i, c in enumerate(w, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        index = decontaminate.build_index([(1, w)])
        b = np.frombuffer(t.encode(), np.uint8)
        edits, _, _ = decontaminate.align(index, b, np.array([0]), np.array([len(t)]), np.array([0]), np.array([27 - decontaminate.BAND]))
        assert min(edits[0], 8) == min(min(row), 8)


def brute_phrases(own: bytes, text: bytes) -> int:
    n = at = 0
    while at < len(text):
        k = at + 1
        while k < len(text) and text[at : k + 1] in own:
            k += 1
        at, n = k, n + 1
    return n


def counted(model, texts):
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    return language_id.phrases(model, data, ends)


def test_cross_parsing_counts_longest_phrases():
    own = {"en": b"the cat sat on the mat and the dog ", "de": b"der hund und die katze ", "xx": bytes(range(97, 123)) + bytes(range(128, 250))}
    model = language_id.compile_automata(own)
    texts = [b"the cat and the dog", b"on the dog sat", b"the", b"mat mat mat ", b"", b"q", bytes([98, 99, 251, 251, 130, 131])]
    got = counted(model, texts)
    for k, name in enumerate(model["languages"]):
        assert got[:, k].tolist() == [brute_phrases(own[name], t) for t in texts]


@pytest.mark.parametrize("part", [1, 7, 512, 4096])
def test_cross_parsing_is_of_whole_texts(monkeypatch, part):
    """Copies of the learned text, whose phrases cross many parts, and texts of words in any order, at lengths around a part's."""
    monkeypatch.setattr(language_id, "PART", part)
    rng = random.Random(part)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    own = " ".join(rng.choice(words) for _ in range(1500)).encode()
    other = " ".join(rng.choice(words) for _ in range(900)).encode()
    model = language_id.compile_automata({"a": own, "b": other})
    texts = [own[100 : 100 + n] for n in (1, 511, 512, 513, 4000, 4097)] + [(own[50:700] + b" zz " + other[9:1500] + own[:3000])[:n] for n in (511, 513, 4000, 5000)]
    got = counted(model, texts)
    assert got[:, 0].tolist() == [brute_phrases(own, t) for t in texts]
    assert got[:, 1].tolist() == [brute_phrases(other, t) for t in texts]
    assert got[4, 0] == 1


def test_language_id(spark, docs, odd, none):
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    got = language_id.identify(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect() if r.doc_id}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {3, 4, 5, 8}
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(none)).collect()} == {"und"}


def learned(rows, spark, sample=language_id.TRAIN_DOCS):
    """Of each language the texts that it is learned from."""
    out = {}
    for r in language_id.training_texts(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", sample).collect():
        out.setdefault(r.l, set()).add(r.t)
    return out


def test_language_model_ranks_distinct_texts(spark):
    own = [f"{w} and more" for w in ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot")]
    alone = learned([(t, "en") for t in own], spark, sample=4)
    assert learned([(t, "en") for t in own for _ in range(9)], spark, sample=4) == alone and len(alone["en"]) == 4


def test_language_model_reads_whole_texts_and_ties(spark):
    long = "long text " * 4000 + "ending"
    rows = [("same words " * 3, "en")] * 20_000 + [(long, "en"), ("wort", "de"), ("x", None), (None, "de")]
    assert learned(rows, spark) == {"en": {"same words " * 3, long}, "de": {"wort"}}


def test_language_model_is_bounded_in_bytes(spark, monkeypatch):
    """Shares of the bytes by the number of languages; a language of long texts only learns from the beginning of one."""
    monkeypatch.setattr(language_id, "TRAIN_BYTES", 100)
    monkeypatch.setattr(language_id, "MODEL_BYTES", 240)
    rows = [(f"{k:02d} " + "a" * 25, "en") for k in range(20)] + [("b" * 500, "de"), ("c" * 90, "fr"), ("c" * 40, "fr")]
    got = learned(rows, spark)
    assert {k: sorted(map(len, v)) for k, v in got.items()} == {"en": [28, 28], "de": [80], "fr": [40]}


def test_thousands_of_languages(spark):
    names = [f"l{k}" for k in range(3000)]
    rows = [(f"{n} {n[::-1]} " * 3, n) for n in names]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(2))
    assert model["languages"] == sorted(names)
    assert len(model["first"]) == 3000 and len(model["mask"]) % model["width"] == 0


def test_long_training_texts_stay_off_the_driver(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    rows = [(" ".join(rng.choice(words) for _ in range(25_000)), "en") for _ in range(12)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model["to"]) < 4 * language_id.TRAIN_BYTES


def test_language_columns_with_clashing_names(spark, docs):
    model = language_id.fit(docs)
    got = language_id.identify(docs.limit(5).withColumn("lang_pred", F.lit(1)).withColumn("lang_score", F.lit("x")), model)
    assert dict(got.dtypes)["lang_pred"] == "string" and dict(got.dtypes)["lang_score"] == "double" and got.count() == 5


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    per_row = np.array([4, 1, 6, 3])
    e, link = rng.normal(size=14), rng.normal(size=(2, 2)) * 0.5
    p, pairs = quality.marginals(e, per_row, link)
    at, total = 0, np.zeros((2, 2))
    for n in per_row:
        mass, good, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(link[y[k], y[k + 1]] for k in range(n - 1)))
            mass += w
            good += w * np.array(y)
            for k in range(n - 1):
                both[y[k], y[k + 1]] += w
        assert np.allclose(p[at : at + n], good / mass)
        total += both / mass
        at += n
    assert np.allclose(pairs, total)


def test_pairs_are_weighted_by_row():
    rng = np.random.default_rng(9)
    per_row, link = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    e, weight = rng.normal(size=9), np.array([0.5, 2.0, 3.0])
    alone = [quality.marginals(e[a:b], np.array([b - a]), link)[1] for a, b in ((0, 3), (3, 4), (4, 9))]
    assert np.allclose(quality.marginals(e, per_row, link, weight)[1], sum(w * p for w, p in zip(weight, alone, strict=True)))


def brute_line(line: bytes):
    """The features of one line but the last, which counts its copies."""
    share = lambda ok: sum(map(ok, line)) / max(1, len(line))
    words = [w for w in __import__("re").split(rb"[ \t-\r]+", line) if w]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n = max(1, len(words))
    return [
        share(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b"!?"), share(lambda c: c in b"#$%&*+<=>@\\^_`~|{}[]/"), share(lambda c: c in b".,;:"),
        np.log1p(len(line)), np.log1p(len(words)), sum(map(len, words)) / n, sum(a == b for a, b in itertools.pairwise(low)) / n, len(set(low)) / n, sum(len(w) <= 3 for w in words) / n,
    ]


def test_line_features_by_hand(docs):
    texts = ["", "\n", "One two two\n\nOne two two\n#$ 12 é!?", *(r.text for r in docs.limit(20).collect())]
    features, size, per_row = quality.line_features(*quality.flat(pa.array(texts)))
    lines = [line for t in texts for line in t.encode().split(b"\n")]
    assert per_row.tolist() == [t.count("\n") + 1 for t in texts] and size.tolist() == [len(x) for x in lines]
    assert np.allclose(features[:, :-1], [brute_line(x) for x in lines])
    assert np.allclose(np.exp(features[3:7, -1]), [2, 1, 2, 1])


def test_quality_with_clashing_names(docs, spark):
    got = quality.score(docs.withColumn("quality_score", F.lit("x")), None)
    assert {r.quality_score for r in got.collect()} == {0.5} and got.count() == docs.count()


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = quality.held_out()
    model = quality.fit(docs, labels.where(~fold))
    got = quality.score(docs.where(fold), model).join(labels, "doc_id").collect()
    assert sum((r.quality_score >= 0.3) == (r.quality == 1) for r in got) > 0.95 * len(got)
    assert all(0 <= r.quality_score <= 1 for r in quality.score(odd, model).collect())
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.score(none, model).count() == 0


def test_pii_patterns():
    rng = random.Random(6)
    parts = ["a.b@c.de", "x@", "@y.z", "a@b@c.org", "1.2.3.4", "300.1.2.3", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (632) 555-4827", "+12", "é@x.com", "99999999", " ", "\n", ".", "-"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(8))
        want = [(0, m.start(), m.end()) for m in pii.EMAIL.finditer(t)]
        assert [x for x in pii.base_spans(t) if x[0] == 0] == want
    assert pii.base_spans("mail a.b@c.de, 1.2.3.4 and 4111 1111 1111 1111, +1 (632) 555-4827") == [(0, 5, 13), (1, 15, 22), (2, 27, 46), (3, 48, 65)]


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    x = rng.integers(0, pii.WIDTH, (5, 3))
    w = [rng.normal(size=s).astype(np.float64) * 0.3 for s in ((pii.WIDTH, 4 * pii.HIDDEN), (pii.HIDDEN, 4 * pii.HIDDEN), (4 * pii.HIDDEN,))]
    dh = rng.normal(size=(5, 3, pii.HIDDEN))
    grads = pii.lstm_gradient(x, w[1], *pii.lstm(x, *w), dh)
    for k, spot in ((0, (int(x[2, 1]), 7)), (1, (3, 20)), (2, (11,))):
        eps, f = 1e-2, []
        for sign in (1, -1):
            v = [a.copy() for a in w]
            v[k][spot] += sign * eps
            f.append((pii.lstm(x, *v)[0][1:] * dh).sum())
        assert abs((f[0] - f[1]) / (2 * eps) - grads[k][spot]) < 2e-2


def brute_digits(text):
    """ip, card and phone spans by a scan of every character, without regular expressions."""
    digit = lambda i: i < len(text) and "0" <= text[i] <= "9"

    def run(i):
        while digit(i):
            i += 1
        return i

    out, i = [], 0
    while i < len(text):
        e = run(i) if digit(i) else i
        parts = [text[i:e]]
        while e > i and len(parts) < 4 and e < len(text) and text[e] == "." and digit(e + 1):
            parts, e = [*parts, text[e + 1 : run(e + 1)]], run(e + 1)
        if len(parts) == 4:
            if all(int(p) <= 255 for p in parts):
                out.append((1, i, e))
            i = e
        else:
            i = run(i) if digit(i) else i + 1
    i = 0
    while i < len(text):
        if not digit(i):
            i += 1
            continue
        e = i + 1
        while digit(e) or (e < len(text) and text[e] in " -" and digit(e + 1)):
            e += 1
        d = [int(c) for c in text[i:e] if "0" <= c <= "9"]
        double = [sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))]
        if len(d) > 1 and 16 <= len(d) <= 19 and sum(double) % 10 == 0:
            out.append((2, i, e))
        i = e
    i = 0
    while i < len(text):
        if text[i] == "+" and digit(i + 1):
            e = i + 2
            while e < len(text) and text[e] in " ().0123456789-":
                e += 1
            while e > i + 2 and not digit(e - 1):
                e -= 1
            if e > i + 3:
                if 8 <= sum("0" <= c <= "9" for c in text[i:e]) <= 15:
                    out.append((3, i, e))
                i = e
                continue
        i += 1
    return out


def test_pii_patterns_by_a_scan():
    rng = random.Random(12)
    parts = ["1.2.3.4", "300.1.2.3", "1.2.3.4.5", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (632) 555-4827", "+12", "++49 30 1", "99999999", " ", "\n", ".", "-", "+", "(", "5", "12", "é"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(7))
        assert [x for x in pii.base_spans(t) if x[0]] == brute_digits(t), t


def paths_of(e, link):
    """Every tag path of one text with its score."""
    for path in itertools.product(range(e.shape[1]), repeat=len(e)):
        yield path, sum(e[t, k] for t, k in enumerate(path)) + sum(link[a, b] for a, b in itertools.pairwise(path))


def test_crf_against_enumeration():
    rng = np.random.default_rng(3)
    e, link = rng.normal(size=(4, 3, 3)) * 3, rng.normal(size=(3, 3)) * 2
    z, marginal, pairs = pii.crf(e, link)
    both = np.zeros((3, 3))
    for n in range(3):
        every = [(p, np.exp(s)) for p, s in paths_of(e[:, n], link)]
        mass = sum(w for _, w in every)
        assert abs(z[n] - np.log(mass)) < 1e-9
        for t in range(4):
            for k in range(3):
                assert abs(marginal[t, n, k] - sum(w for p, w in every if p[t] == k) / mass) < 1e-9
        for p, w in every:
            for a, b in itertools.pairwise(p):
                both[a, b] += w / mass
    assert np.allclose(pairs, both)


def test_viterbi_against_enumeration(monkeypatch):
    """Best paths of whole texts; stretches that are left out are tag 0 on every best path."""
    monkeypatch.setattr(pii, "TAGS", 3)
    rng = np.random.default_rng(7)
    settled = 0
    for _ in range(150):
        sizes = rng.integers(0, 7, 4)
        ends = np.cumsum([0, *sizes])
        e, link = rng.normal(size=(ends[-1], 3)) * 2, rng.normal(size=(3, 3)) * 1.5
        e[:, 0] += rng.choice([0, 3])
        path = pii.viterbi(e, link, ends)
        settled += int((~pii.unsettled(e, link)).sum())
        for a, b in itertools.pairwise(ends):
            assert b == a or tuple(path[a:b]) == max(paths_of(e[a:b], link), key=lambda x: x[1])[0]
    assert settled > 100


@pytest.fixture(scope="module")
def pii_model():
    return pii.fit()


def test_pii_scores_do_not_depend_on_neighbours(pii_model):
    texts = ["", "x", "a b c " * 40, "mail maria@exämple.de now " * 9, "y" * 97]
    whole, ends = pii.scores(pii_model, texts)
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert np.allclose(pii.scores(pii_model, [t])[0], whole[a:b], atol=1e-4)
    for t in texts[2:]:
        e = np.zeros((len(t), pii.TAGS))
        weight = np.zeros((len(t), 1))
        for at in pii.starts(len(t)):
            x = np.full(pii.SPAN, pii.SYMBOLS[32])
            x[: len(t) - at] = pii.encode(t[at : at + pii.SPAN])
            own = pii.emissions(pii_model, x[:, None])[0][:, 0]
            for k in range(min(pii.SPAN, len(t) - at)):
                w = min(k, pii.SPAN - 1 - k) + 1
                e[at + k] += w * own[k]
                weight[at + k] += w
        assert np.allclose(pii.scores(pii_model, [t])[0], e / weight, atol=1e-3)


def test_pii_finds_disguised_items_of_a_held_out_table(pii_model):
    """Items made by the table's rules from another seed, where the patterns find nothing or just the item."""
    held = pii.synthetic(800, seed=77)
    right = found = there = added = 0
    for (_, spans), (base, every) in zip(held, pii.find(pii_model, pa.array([t for t, _ in held])), strict=True):
        if all(b in spans for b in base):
            right += len(set(spans) & set(every))
            found, there = found + len(every), there + len(spans)
            added += len((set(every) - set(base)) & set(spans))
    assert added > 100 and right > 0.93 * found and right > 0.93 * there


def test_pii(spark, odd, none, pii_model):
    model = pii_model
    text = "call (632) 555-4827 or a.b@c.de now; version 2.0.1, key AKIA4711, host 10[.]2[.]3[.]4 ok"
    base, every = pii.find(model, pa.array([text]))[0]
    assert [text[s:e] for _, s, e in base] == ["a.b@c.de"]
    assert set(base) <= set(every)
    assert {text[s:e] for _, s, e in every} == {"a.b@c.de", "(632) 555-4827", "10[.]2[.]3[.]4"}
    text = "write to maria.lopez@exämple.de or user@münchener-stadtbibliothek.example.org now"
    assert [text[s:e] for _, s, e in pii.find(model, pa.array([text]))[0][1]] == ["maria.lopez@exämple.de", "user@münchener-stadtbibliothek.example.org"]
    got = pii.find_pii(odd.withColumn("pii_spans", F.lit(3)), model).collect()
    assert len(got) == len(ODD)
    assert {r.pii_spans for r in got} == {""}
    assert pii.find_pii(none, model).count() == 0
    assert pii.redact(spark.createDataFrame([("x a.b@c.de y",)], "text string"), model).first().text == "x <email> y"


@pytest.fixture(scope="module")
def lm(docs):
    return lm_score.fit(docs)


def test_lm_scores(spark, docs, odd, none, lm):
    model = lm
    got = {r.doc_id: r for r in lm_score.score(docs, model).collect()}
    lex, p = model["lex"], lm_score.unpack(model["weights"])
    for d in docs.limit(5).collect():
        hashed, suffix, n = lm_score.tokens(pa.array([d.text]))
        cls, share = lm_score.classed(lex, hashed, suffix)
        total = 0.0
        for k in range(len(cls)):
            around = [cls[j] if 0 <= j < len(cls) else lm_score.PAD for j in (k - 2, k - 1, k + 1, k + 2)]
            z = np.tanh(p["e"][around].ravel() @ p["w"] + p["b"]) @ p["v"] + p["c"]
            total += z[cls[k]] - np.log(np.exp(z).sum()) + share[k]
        assert abs(total - got[d.doc_id].lm_logprob) < 1e-3 * abs(total)
        assert got[d.doc_id].lm_tokens == len(d.text.split()) == n[0]
    first = {"lex": lex, "weights": lm_score.first_weights(lex["total"])}
    assert sum(r.lm_logprob for r in got.values()) > sum(r.lm_logprob for r in lm_score.score(docs, first).collect())
    out = {r.doc_id: r for r in lm_score.score(odd, model).collect()}
    assert (out[3].lm_tokens, out[3].lm_logprob, out[3].lm_mean) == (0, 0.0, None)
    assert lm_score.score(none, model).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("lm_tokens", "lm_batch", "LM_words", "lm_rare", "lm_row", "lm_share")})
    again = lm_score.score(clash, model).collect()
    assert {r.doc_id: r.lm_logprob for r in again} == {k: r.lm_logprob for k, r in got.items()} and {r.lm_batch + r.LM_words + r.lm_rare + r.lm_row + r.lm_share for r in again} == {"x" * 5}


def test_lm_of_nothing(none):
    assert lm_score.fit_and_score(none).count() == 0


def test_lm_scores_do_not_depend_on_partitions(docs):
    few, many = (({r.doc_id: r.lm_logprob for r in lm_score.fit_and_score(docs.select("doc_id", "text").repartition(n)).collect()}) for n in (2, 16))
    assert all(abs(few[k] - many[k]) <= 1e-6 * max(1, abs(few[k])) for k in few) and few.keys() == many.keys()


def test_lm_gradient(monkeypatch):
    rng = np.random.default_rng(4)
    n = np.array([7, 1, 0, 12])
    cls = rng.integers(0, lm_score.CLASSES, n.sum())
    around, w = lm_score.contexts(cls, n), lm_score.first_weights() * 3
    loss = lambda w: -sum((z := np.tanh(p["e"][a].ravel() @ p["w"] + p["b"]) @ p["v"] + p["c"])[c] - np.log(np.exp(z).sum()) for p in [lm_score.unpack(w)] for a, c in zip(around, cls, strict=True))
    monkeypatch.setattr(lm_score, "KIND", np.float64)
    g = lm_score.gradient(lm_score.unpack(w), around, cls, step=5)
    for k in rng.integers(0, len(w), 60):
        up, down = w.copy(), w.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[k]) < 1e-5


def test_lm_training_takes_every_position(spark, docs, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    plain = lm_score.gradient

    def counted(p, around, cls):
        seen.add(len(cls))
        return plain(p, around, cls)

    monkeypatch.setattr(lm_score, "gradient", counted)
    lm_score.fit(docs)
    assert seen.value == sum(len(r.text.split()) for r in docs.collect())


def test_lm_words_beyond_the_vocabulary_keep_their_counts(spark, docs, odd, lm, monkeypatch):
    whole = lm
    monkeypatch.setattr(lm_score, "VOCABULARY", 200)
    part = lm_score.fit(docs)
    assert whole["others"] is None and part["others"] is not None and len(part["lex"]["word"]) <= 200
    # The same classes and weights, so that only the shares' way to the words differs.
    same = {**part, "weights": whole["weights"]}
    for table in (docs, odd):
        want = [tuple(r) for r in lm_score.score(table, whole).select("doc_id", "lm_tokens", "lm_logprob", "lm_mean").collect()]
        got = [tuple(r) for r in lm_score.score(table, same, keep_text=False).select("doc_id", "lm_tokens", "lm_logprob", "lm_mean").collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * max(1, abs(a[2])) and (a[3] is None) == (b[3] is None)


def test_shares_sum_to_one_in_each_class(docs):
    lex = lm_score.lexicon(docs, "text")
    counts = {(r.word, r.cls): r.n for r in lm_score.word_counts(docs, "text").collect()}
    word = np.array([w for w, _ in counts], np.int64).view(np.uint64)
    cls, share = lm_score.classed(lex, word, np.array([c for _, c in counts]))
    sums = np.bincount(cls, np.exp(share), minlength=lm_score.CLASSES)
    assert (sums < 1 + 1e-9).all() and (sums[np.unique(cls)] > 0.4).all()


def test_pipeline(spark, sf):
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert docs.count() <= before.count()
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_odd_rows(spark, sf, odd, none, docs):
    """Nulls, empty and long texts, repeats, extra columns with clashing names, an empty table: each stage's defined result."""
    clash = {c: F.lit("x") for c in ("mix_kept", "mix_tokens", "contaminated", "lang_pred", "told", "score", "corvid_gone", "shard", "size")}
    table = odd.unionByName(docs.limit(80), allowMissingColumns=True).withColumns(clash)
    ids = {name: sorted(r.doc_id or 0 for r in stage(spark, table, sf).collect()) for name, stage in corpus_pipeline.STAGES}
    every = sorted(r.doc_id or 0 for r in table.collect())
    # Texts: 1, 2, 2 and the null id are equal; 3 null, 4 empty, 5 blank, 6 a word, 7 long, 8 digits.
    own = sorted(r[0] or 0 for r in ODD)
    real = [r.doc_id for r in docs.limit(80).collect()]
    assert min(real) >= 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, sf).columns == table.columns
        assert stage(spark, none.withColumns(clash), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf).count() == 0
    assert ids["language_id"] == sorted(x for r in table.collect() for x in [r.doc_id or 0] if r.text and any(c.isalpha() for c in r.text))
    assert len(ids["sharding"]) == len(every) and ids["sharding"] == every
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, sf).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 4, 5, 6, 7, 8] and kept.count(None) == 1
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.benchmark_free(spark, odd, sf).collect()) == own
    fate = {}
    for r in corpus_pipeline.mixture(spark, odd, sf).collect():
        fate[r.doc_id] = fate.get(r.doc_id, 0) + 1
    kept = {}
    for r in mixing.mix(odd).where("mix_kept").collect():
        kept[r.doc_id] = kept.get(r.doc_id, 0) + 1
    assert fate == kept and fate.get(2, 0) in (0, 2) and 0 < sum(fate.values()) < len(ODD)


def test_pipeline_goes_on_after_its_last_whole_stage(spark, sf, tmp_path, monkeypatch):
    done = []

    def stage(name, fails=False):
        def run(spark, docs, sf_dir):
            if fails:
                raise OSError("lost")
            done.append(name)
            return docs.where(f"doc_id % {len(done) + 1} = 0")

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b", fails=True), stage("c")])
    with pytest.raises(OSError):
        corpus_pipeline.run(spark, sf, f"{tmp_path}/p")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    got = corpus_pipeline.run(spark, sf, f"{tmp_path}/p")
    assert done == ["a", "b", "c"] and all(r.doc_id % 12 == 0 for r in got.collect())
    assert [p.name for p in (tmp_path / "p").iterdir()] == ["2-c"]


def test_near_duplicate_stage_keeps_one_of_each(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, _, c in found})
