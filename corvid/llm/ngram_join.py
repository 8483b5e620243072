"""Exact Jaccard self-join of word shingles by multiple-global-order filtering.

Two sets of Jaccard similarity t or more share a token among the first
n - ceil(t * n) + 1 of each under any order of all tokens. Three orders are
used; all put tokens that very many texts share last, so that a common passage
or a large group of copies brings no candidates by itself:

1. by that frequency, then longest first, then by a hash: its prefixes are
   dealt to buckets, and bring together documents of compatible sizes;
2. and 3. by that frequency, then by two other hashes: within a group of
   candidates, only pairs that share prefix tokens under these too are
   verified, by counting all tokens that they have in common.

Identical sets are one node from the start. A bucket never lists its pairs:
its documents join the group of the bucket's first document in a window of
sizes, each document once per group, and a group yields only the links that
its components need. Groups of very many tokens are split into pieces with a
copy of the first document in each; only what a piece does not join to it, its
strays, then meets the other pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.components import components
from corvid.llm.frames import tidy, unused
from corvid.llm.textbytes import flat, mix, slices, words
from corvid.llm.toplist import count_cut
from corvid.sources.tables import materialize

#: Tokens that are ordered last for their frequency, at most.
HOT = 1 << 21
#: Tokens in one piece of a group.
BLOCK_TOKENS = 1 << 19
#: Parts that the members of one group are dealt to, where they are joined to their group.
SALTS = 16
#: Buckets of the bit map that spares documents which are in no group.
MAP = 1 << 22
NEAR = 1 << 20
SEEDS = tuple(np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))


def row_sets(column: pa.Array, width: int):
    """(set of tokens, sorted) of each row: distinct hashes of `width` words; fewer words are one token together, none are no token.

    A token's low six bits are its length class.
    """
    hashed, length, _, n = words(*flat(column))
    a, c = hashed, length
    out = mix(hashed)
    size = length.copy()
    for k in range(1, width):
        a = np.roll(a, -1)
        out = mix(out + a * np.uint64(2 * k + 1))
        size = size + np.roll(c, -k)
    tokens = (out & ~np.uint64(63)) | np.minimum(63, size // 2).astype(np.uint64)
    ends = np.cumsum(n)
    for end, k in zip(ends.tolist(), n.tolist(), strict=True):
        if k >= width:
            yield np.unique(tokens[end - k : end - width + 1])
        elif k:
            h = np.full(1, k, np.uint64)
            for w in range(end - k, end):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashed[w : w + 1])
            yield (h & ~np.uint64(63)) | np.uint64(min(63, int(length[end - k : end].sum()) // 2))
        else:
            yield np.zeros(0, np.uint64)


def name_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    a = mix(tokens + SEEDS[0]).sum(dtype=np.uint64) if len(tokens) else np.uint64(0)
    b = mix(tokens ^ SEEDS[1]).sum(dtype=np.uint64) if len(tokens) else np.uint64(0)
    pair = np.array([a, b], np.uint64).view(np.int64)
    return int(pair[0]), int(pair[1])


def order_keys(tokens: np.ndarray, order: int, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Sort keys of tokens under a global order: `level` of frequent tokens, else 0; for order 0 then longest first; then a hash."""
    key = mix(tokens ^ SEEDS[order]) >> np.uint64(12)
    if order == 0:
        key |= (np.uint64(63) - (tokens & np.uint64(63))) << np.uint64(52)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        key |= np.where(hot[at] == tokens, level[at], np.uint8(0)).astype(np.uint64) << np.uint64(58)
    return key


def prefix(tokens: np.ndarray, order: int, percent: int, hot: np.ndarray, level: np.ndarray, stretch: float = 1.0) -> np.ndarray:
    n = len(tokens)
    p = int((n - (percent * n + 99) // 100 + 1) * stretch)
    if p >= n:
        return tokens
    return tokens[np.argpartition(order_keys(tokens, order, hot, level), p - 1)[:p]]


def longs(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x, pa.int64())


def profile(docs: DataFrame, width: int) -> DataFrame:
    """(id, s1, s2, n): the name and size of every document's set."""

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(1)):
                own = list(row_sets(b.column(1).slice(lo, hi - lo), width))
                names = [name_of(s) for s in own]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), longs([x for x, _ in names]), longs([y for _, y in names]), longs([len(s) for s in own])], names=["id", "s1", "s2", "n"])

    return docs.mapInArrow(tidy(run), "id long, s1 long, s2 long, n long")


def frequent_tokens(docs: DataFrame, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sorted; their levels): at most HOT most frequent tokens among the first of every set, longest first.

    Counted are prefixes of one and a half times the needed length, as frequent
    tokens give their places to later ones. Any order of tokens gives the same
    links, so what is not counted costs time only.
    """

    def run(batches):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        seen = set()
        for b in batches:
            for lo, hi in slices(b.column(1)):
                parts = []
                for s in row_sets(b.column(1).slice(lo, hi - lo), width):
                    if len(s) and (name := name_of(s)) not in seen:
                        seen.add(name)
                        parts.append(prefix(s, 0, percent, *none, stretch=1.5))
                if parts:
                    token, count = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([longs(token), longs(count)], names=["token", "n"])

    counts = docs.mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("df")).where("df > 2")
    counts = materialize(counts)
    found = counts.where(F.col("df") >= F.lit(count_cut(counts, "df", HOT))).toArrow()
    token, df = found.column("token").to_numpy().view(np.uint64), found.column("df").to_numpy()
    order = np.argsort(token)
    return token[order], np.minimum(63, 1 + np.log2(df[order].astype(float))).astype(np.uint8)


def bucket_rows(docs: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """(token, n, s1, s2) of the order-0 prefix tokens; a partition names each set once."""

    def run(batches):
        hot, level = shared.value
        seen = set()
        for b in batches:
            for lo, hi in slices(b.column(1)):
                toks, sizes, firsts, seconds = [], [], [], []
                for s in row_sets(b.column(1).slice(lo, hi - lo), width):
                    if len(s) and (name := name_of(s)) not in seen:
                        seen.add(name)
                        p = prefix(s, 0, percent, hot, level)
                        toks.append(p)
                        sizes.append(np.full(len(p), len(s)))
                        firsts.append(np.full(len(p), name[0]))
                        seconds.append(np.full(len(p), name[1]))
                if toks:
                    yield pa.RecordBatch.from_arrays([longs(np.concatenate(toks)), *(longs(np.concatenate(x)) for x in (sizes, firsts, seconds))], names=["token", "n", "s1", "s2"])

    return docs.mapInArrow(tidy(run), "token long, n long, s1 long, s2 long")


def memberships(percent: int):
    """A sorted stream of bucket rows to (c1, c2, m1, m2, n): each set with the center of its size windows, centers included once they have a member."""

    def run(batches):
        held, before, token, centers, last = None, None, None, [], None
        for b in batches:
            t = pa.Table.from_batches([b]).combine_chunks()
            if held is not None:
                t = pa.concat_tables([held, t])
            rows = np.stack([t.column(k).to_numpy() for k in range(4)], axis=1)
            # Only tokens of two rows or more can bring anything; the last row waits for its successor, `before` is the token of the row before it.
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.concatenate([same, [False]])
            keep[1:] |= same
            if before is not None and len(rows):
                keep[0] |= rows[0, 0] == before
            out = []
            for tok, n, s1, s2 in rows[:-1][keep[:-1]].tolist():
                token, centers, last = step(out, tok, n, s1, s2, token, centers, last, percent)
            held = t.slice(t.num_rows - 1) if t.num_rows else None
            before = rows[-2, 0] if len(rows) > 1 else before
            if out:
                yield packed(out)
        if held is not None and held.num_rows:
            out = []
            step(out, *(held.column(k)[0].as_py() for k in range(4)), token, centers, last, percent)
            if out:
                yield packed(out)

    return run


def packed(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(list(x)) for x in zip(*out, strict=True)], names=["c1", "c2", "m1", "m2", "n"])


def step(out, tok, n, s1, s2, token, centers, last, percent):
    """One bucket row. A window opens at size a; the next one at the first size over a / t; a window takes sizes up to a / t ** 2."""
    if tok != token:
        centers, last = [], None
    if (s1, s2) != last:
        if not centers or n * percent > centers[-1][0] * 100:
            centers = centers[-1:] + [[n, s1, s2, False]]
        for c in centers:
            if n * percent * percent <= c[0] * 10_000 and (s1, s2) != (c[1], c[2]):
                if not c[3]:
                    c[3] = True
                    out.append((c[1], c[2], c[1], c[2], c[0]))
                out.append((c[1], c[2], s1, s2, n))
    return tok, centers, (s1, s2)


def group_links(ids: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int, hot, level) -> list[tuple[int, int]]:
    """Links that make a group's components: pairs of sets of different blocks (any, if there is one block) verified one pivot at a time.

    A pivot is held only against sets that are not in its component yet, have
    a compatible size and share prefix tokens with it under orders 1 and 2.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        small, large = sorted((0, 1), key=lambda k: size[k])
        if size[small] * 100 < percent * size[large]:
            return []
        for order in (1, 2):
            if not len(np.intersect1d(prefix(sets[0], order, percent, hot, level), prefix(sets[1], order, percent, hot, level), assume_unique=True)):
                return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if 100 * both >= percent * (size.sum() - both) else []

    def postings(parts: list[np.ndarray]):
        token = np.concatenate(parts)
        owner = np.repeat(np.arange(m, dtype=np.int32), [len(p) for p in parts])
        order = np.argsort(token, kind="stable")
        ranked = token[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        dense = np.empty(len(token), np.int32)
        dense[order] = np.cumsum(new) - 1
        ptr = np.append(np.flatnonzero(new), len(token))
        return dense, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), ptr, owner[order]

    def shared(index, k):
        dense, own, ptr, owner = index
        t = dense[own[k] : own[k + 1]]
        n = ptr[t + 1] - ptr[t]
        return owner[np.repeat(ptr[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    filters = [postings([prefix(s, order, percent, hot, level) for s in sets]) for order in (1, 2)]
    whole = postings(sets)
    label, links, two = np.arange(m), [], block.min() != block.max()
    for k in range(m):
        may = (label != label[k]) & (np.minimum(size, size[k]) * 100 >= percent * np.maximum(size, size[k]))
        may[: k + 1] = False
        if two:
            may &= block != block[k]
        for index in filters:
            if not may.any():
                break
            meets = np.zeros(m, bool)
            meets[shared(index, k)] = True
            may &= meets
        if not may.any():
            continue
        both = np.bincount(shared(whole, k), minlength=m)
        for j in np.flatnonzero(may & (100 * both >= percent * (size + size[k] - both))):
            if label[j] != label[k]:
                links.append((int(ids[k]), int(ids[j])))
                label[label == label[j]] = label[k]
    return links


def reached(center: int, links: list[tuple[int, int]]) -> set[int]:
    """The ids that links join to `center`, itself included."""
    near = {}
    for u, v in links:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    found, todo = {center}, [center]
    while todo:
        for v in near.get(todo.pop(), []):
            if v not in found:
                found.add(v)
                todo.append(v)
    return found


def linked(percent: int, shared):
    """A stream of (g, block, id, set) sorted by g and id to links (null, u, v), and to strays (g, s1, s2).

    A piece of a split group holds the group's center as block -1; its strays
    are the names of those sets that its links do not join to the center.
    """

    def flush(g, rows):
        unique = {}
        for block, id, s in rows:
            unique.setdefault((id, s), block)
        keys = list(unique)
        block = np.array([unique[k] for k in keys], int)
        split = len(block) and block.min() < 0
        sets = [np.frombuffer(k[1], np.uint64) for k in keys]
        links = group_links(np.array([k[0] for k in keys]), np.zeros(len(keys), int) if split else block, sets, percent, *shared.value) if len(keys) > 1 else []
        out = [(None, u, v) for u, v in links]
        if split:
            met = reached(keys[int(block.argmin())][0], links)
            out += [(g, *name_of(s)) for k, s in zip(keys, sets, strict=True) if k[0] not in met]
        return out

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), longs([x[1] for x in out]), longs([x[2] for x in out])], names=["g", "u", "v"])

    def run(batches):
        group, rows = None, []
        for b in batches:
            out = []
            for g, block, id, s in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                if g != group:
                    out += flush(group, rows)
                    group, rows = g, []
                rows.append((block, id, s.as_py()))
            if out:
                yield rows_of(out)
        if out := flush(group, rows):
            yield rows_of(out)

    return run


def candidate_groups(members: DataFrame) -> DataFrame:
    """(g, block, c1, c2, b, k, s1, s2, n): the members of each piece g. A group of more than BLOCK_TOKENS is split into b pieces, each with a copy of the center as block -1."""
    members = materialize(members)
    blocks = members.groupBy("c1", "c2").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("int").alias("b"))
    # Only split groups are joined, one row for each BLOCK_TOKENS of members at most; salts spread a group of very many.
    split = blocks.where("b > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = members.withColumn("salt", F.pmod(F.xxhash64("m1"), F.lit(SALTS)).cast("int")).join(split, ["c1", "c2", "salt"], "left")
    rows = rows.withColumn("b", F.coalesce("b", F.lit(1))).withColumn("center", F.expr("b > 1 and m1 = c1 and m2 = c2"))
    home = F.pmod(F.xxhash64("m1", "m2"), F.col("b").cast("long")).cast("int")
    rows = rows.withColumn("k", F.explode(F.when(F.col("center"), F.sequence(F.lit(0), F.col("b") - 1)).otherwise(F.array(home))))
    return rows.select(F.concat_ws(":", "c1", "c2", "k").alias("g"), F.when(F.col("center"), -1).otherwise(0).alias("block"), "c1", "c2", "b", "k", F.col("m1").alias("s1"), F.col("m2").alias("s2"), "n")


def stray_groups(members: DataFrame, strays: DataFrame) -> DataFrame:
    """(g, block, s1, s2, rep): pieces in which every stray of a split group meets all members of the group's other pieces.

    Members that are joined to their group's center are in one component
    already, so they do not meet each other again.
    """
    home = members.where("b > 1 and block = 0").join(strays.withColumn("stray", F.lit(True)), ["g", "s1", "s2"], "left").drop("g", "block")
    blocks = home.where("stray").groupBy("c1", "c2").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("int").alias("of"))
    home = materialize(home.join(blocks, ["c1", "c2"]))
    stay = home.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i"), F.col("k").alias("j"), F.lit(1).alias("block"))
    move = home.where("stray").withColumn("i", F.pmod(F.xxhash64("s2", "s1"), F.col("of").cast("long")).cast("int"))
    move = move.select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"), F.lit(0).alias("block")).where("j <> k")
    return stay.unionByName(move).select(F.concat_ws(":", "c1", "c2", "i", "j").alias("g"), "block", "s1", "s2", "rep")


def piece_links(slim: DataFrame, members: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """(g, u, v), as `linked` yields them, of pieces `members` (g, block, rep, s1, s2); the sets come from the texts of `slim` (id, text)."""
    spark = slim.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A bit map of bounded size; at worst it spares nothing.
    bits = np.zeros(MAP, bool)
    bits[[r[0] for r in members.select(F.pmod(F.xxhash64("rep"), F.lit(MAP)).cast("int")).distinct().collect()]] = True
    mapped = spark.sparkContext.broadcast(np.packbits(bits))

    def sets(batches):
        on = np.unpackbits(mapped.value).astype(bool)
        for b in batches:
            at = np.flatnonzero(on[b.column(2).to_numpy()])
            if not len(at):
                continue
            picked = b.take(pa.array(at))
            for lo, hi in slices(picked.column(1)):
                own = list(row_sets(picked.column(1).slice(lo, hi - lo), width))
                names = [name_of(s) for s in own]
                yield pa.RecordBatch.from_arrays([picked.column(0).slice(lo, hi - lo), longs([x for x, _ in names]), longs([y for _, y in names]), pa.array([s.tobytes() for s in own], pa.binary())], names=["rep", "s1", "s2", "tokens"])

    hashed = slim.where("id is not null").withColumn("at", F.pmod(F.xxhash64("id"), F.lit(MAP)).cast("int"))
    own = hashed.mapInArrow(tidy(sets), "rep long, s1 long, s2 long, tokens binary")
    dealt = members.select("g", "block", "rep", "s1", "s2").join(own, ["rep", "s1", "s2"]).select("g", "block", "rep", "tokens")
    return materialize(dealt.repartition(parts, "g").sortWithinPartitions("g", "rep").mapInArrow(tidy(linked(percent, shared)), "g string, u long, v long"))


def jaccard_components(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Documents link when 100 * |A and B| >= percent * |A or B| over their sets
    of `width`-word shingles (A-Z lowered, words between ASCII blanks); a
    component's id is its smallest doc_id. Null or blank texts have no
    shingles and are linked with nothing. Rows of a null id are linked with
    nothing and have a null component_id. Repeated rows each get their row.
    An empty table gives an empty table. Other columns are not read, whatever
    their names. Shingles are compared by 58-bit hashes and sets named by 128.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = materialize(profile(slim, width))
    live = rows.where("n > 0 and id is not null")
    shared = spark.sparkContext.broadcast(frequent_tokens(slim.where("id is not null"), width, percent))
    buckets = bucket_rows(slim.where("id is not null"), width, percent, shared)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = buckets.repartition(parts, "token").sortWithinPartitions("token", "n", "s1", "s2").mapInArrow(tidy(memberships(percent)), "c1 long, c2 long, m1 long, m2 long, n long").distinct()
    groups = materialize(candidate_groups(members))
    classes = materialize(live.groupBy("s1", "s2").agg(F.min("id").alias("rep")))
    members = materialize(groups.join(classes, ["s1", "s2"]))
    met = piece_links(slim, members, width, percent, shared)
    links = met.where("g is null").select("u", "v")
    strays = met.where("g is not null").select("g", F.col("u").alias("s1"), F.col("v").alias("s2")).distinct()
    if not strays.isEmpty():
        across = piece_links(slim, materialize(stray_groups(members, strays)), width, percent, shared)
        links = links.unionByName(across.select("u", "v"))
    roots = components(links)
    named = rows.join(classes, ["s1", "s2"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.coalesce("root", "rep")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 3, percent: int = 90) -> DataFrame:
    """`docs` without the documents whose component has a smaller id. Rows of one id stay or go together; other columns may have any names."""
    found = jaccard_components(docs, text, id, width, percent)
    lost, spot, of = unused(docs, "gone_id", "gone_at", "id_at")
    gone = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias(lost)).distinct())
    # Rows whose hash no dropped id has stay without a shuffle; the hashes are NEAR at most.
    at = F.pmod(F.xxhash64(F.col(id).cast("long")), F.lit(NEAR)).cast("int")
    near = gone.select(F.pmod(F.xxhash64(lost), F.lit(NEAR)).cast("int").alias(spot)).distinct()
    flagged = lambda how: docs.withColumn(of, at).join(F.broadcast(near), F.col(of) == F.col(spot), how).drop(of, spot)
    kept = flagged("left_semi").join(gone, F.col(id) == F.col(lost), "left_anti")
    return flagged("left_anti").unionByName(kept)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` whose 3-word shingle sets overlap by 90 %."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
