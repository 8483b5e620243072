"""Similarity audit between a corpus and a benchmark."""

from __future__ import annotations

import difflib
import hashlib
import itertools
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from corvid.functions.text import barrier, hash60, shingle_hashes, shingles, tokens
from corvid.operators import overlap


def shingle_rows(df: DataFrame, id: str, text: str = "text", width: int = 5, least: int = 1, hashed: bool = False) -> DataFrame:
    """(id, n, s): one row per distinct shingle of each row with at least `least` of them; n is the set's size.

    With `hashed` a shingle is a 64-bit hash: against a benchmark of 10^5 shingles, 10^13 others are expected to give 0.05 false equals.
    """
    sets = shingle_sets(df, id, text, width, hashed).where(F.size("s") >= least)
    return sets.select(id, F.size("s").cast("bigint").alias("n"), F.explode("s").alias("s"))


def shingle_sets(df: DataFrame, id: str, text: str = "text", width: int = 5, hashed: bool = False) -> DataFrame:
    """(id, s): the distinct shingles of each row in one array."""
    toks = barrier(df.select(id, tokens(F.col(text)).alias("t")), "t")
    return barrier(toks.select(id, (shingle_hashes if hashed else shingles)(F.col("t"), width).alias("s")), "s")


def set_overlap(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n_a, n_b, shared, jaccard, containment) of pairs that share a shingle.

    `left` and `right` are shingle_rows. Only shingles of the other side are
    joined and counted; Catalyst broadcasts a side that its size limit admits.
    """
    l, r = left.withColumnRenamed("n", "n_a"), right.withColumnRenamed("n", "n_b")
    shared = l.join(r, "s").groupBy(a, b, "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    sizes = F.col("shared"), F.col("n_a"), F.col("n_b")
    return shared.withColumns({"jaccard": set_jaccard(*sizes), "containment": set_containment(*sizes)})


def contaminated_pairs(docs: DataFrame, bench: DataFrame, width: int = 5, least: int = 8, jaccard: float = 0.80, containment: float = 0.95) -> DataFrame:
    """Pairs (doc_id, item_id) whose similarity reaches either threshold."""
    pairs = set_overlap(shingle_rows(docs, "doc_id", width=width, least=least, hashed=True), shingle_rows(bench, "item_id", width=width, least=least, hashed=True), "doc_id", "item_id")
    return pairs.where((F.col("jaccard") >= jaccard) | (F.col("containment") >= containment))


def top_candidates(pairs: DataFrame, k: int) -> DataFrame:
    """The k documents that share most shingles with each item, rank included; the smaller id first on ties."""
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_pairs(left: DataFrame, right: DataFrame, a: str, b: str, digest: str) -> DataFrame:
    """Pairs of equal digests; the digest of the empty text never matches."""
    empty = hashlib.sha256(b"").hexdigest()
    return left.where(F.col(digest) != empty).select(a, digest).join(right.select(b, digest), digest)


# Fixed value: 2 ** 64 over the golden ratio.
PHI = 11400714819323198485
#: Runs of words that are hashed at once.
SHINGLES = 4096


# Slots map a shingle's one hash h to (a * h + b) modulo this prime; a and b come from md5 of the slot's name.
PRIME = (1 << 31) - 1


def slot_factors(slots: int) -> list[tuple[int, int]]:
    word = lambda name: int(hashlib.md5(name.encode()).hexdigest()[:15], 16)
    return [(word(f"a{k}") % (PRIME - 1) + 1, word(f"b{k}") % PRIME) for k in range(slots)]


def portable_minhash(rows: DataFrame, id: str, slots: int = 16) -> DataFrame:
    """(id, sig): per slot, the least value of the shingles' hashes under the slot's map; each shingle is hashed once."""
    hashed = rows.select(id, (hash60(F.col("s")) % PRIME).alias("h"))
    least = [F.min((F.col("h") * a + b) % PRIME).alias(f"m{k}") for k, (a, b) in enumerate(slot_factors(slots))]
    return hashed.groupBy(id).agg(*least).select(id, F.array(*(f"m{k}" for k in range(slots))).alias("sig"))


def portable_slots(rows: DataFrame, id: str, slots: int = 16) -> DataFrame:
    """(id, sig): per slot, the least hash60 of the shingles with the slot's number before them; a slot hashes every shingle anew."""
    least = [F.min(hash60(F.concat(F.lit(f"{k}:"), F.col("s")))).alias(f"m{k}") for k in range(slots)]
    return rows.groupBy(id).agg(*least).select(id, F.array(*(f"m{k}" for k in range(slots))).alias("sig"))


def portable_simhash(rows: DataFrame, id: str, bits: int = 60) -> DataFrame:
    """(id, n, simhash): bit k is set where more shingles' hashes have it than not."""
    hashed = rows.select(id, "n", hash60(F.col("s")).alias("h"))
    sums = [F.sum(F.getbit("h", F.lit(k)).cast("int") * 2 - 1).alias(f"b{k}") for k in range(bits)]
    value = F.lit(0).cast("bigint")
    for k in range(bits):
        value = value + F.when(F.col(f"b{k}") > 0, F.lit(1 << k)).otherwise(F.lit(0).cast("bigint"))
    return hashed.groupBy(id, "n").agg(*sums).select(id, "n", value.alias("simhash"))


def blake_signed(sets) -> pa.Array:
    """The signatures of sets of shingles, one set at a time, hashed in blocks of SHINGLES."""
    digest = lambda x: hashlib.blake2b(x.encode(), digest_size=8).digest()
    # The slots' seeds are the hashes of these names.
    seeds = np.frombuffer(b"".join(digest(f"seed_{k}") for k in range(64)), dtype="<u8")[:, None]
    minhashes, simhashes = [], []
    for runs in sets:
        slots, votes = np.full(64, ~np.uint64(0)), np.zeros(64, dtype=np.int64)
        for block in itertools.batched(runs, SHINGLES):
            h = np.frombuffer(b"".join(map(digest, block)), dtype="<u8")
            slots = np.minimum(slots, ((h[None, :] ^ seeds) * np.uint64(PHI)).min(axis=1))
            votes += ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64).sum(axis=0) * 2 - len(h)
        sim = sum(1 << k for k in range(64) if votes[k] > 0)
        minhashes.append(slots.view(np.int64).tolist() if len(runs) else [0] * 64)
        simhashes.append(sim - (1 << 64) if sim >> 63 else sim)
    return pa.StructArray.from_arrays([pa.array(minhashes, pa.list_(pa.int64())), pa.array(simhashes, pa.int64())], ["minhash", "simhash"])


# Types as objects: a string would need a running session at import.
SIGNATURES = StructType([StructField("minhash", ArrayType(LongType())), StructField("simhash", LongType())])


@F.arrow_udf(SIGNATURES)
def blake_signatures(sets: pa.Array) -> pa.Array:
    """64 MinHash slots and a 64-bit SimHash over 8-byte blake2b hashes (little-endian), as signed bit patterns; no shingles: zeros."""
    return blake_signed(s.as_py() or [] for s in sets)


@F.arrow_udf(SIGNATURES)
def blake_text_signatures(texts: pa.Array) -> pa.Array:
    """As blake_signatures, of the distinct runs of 5 words of texts of words parted by one blank; fewer words are a set of themselves. A batch holds texts only, and runs are made for one text at a time."""

    def runs(text):
        words = text.split(" ") if text else []
        return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else set(words)

    return blake_signed(runs(t.as_py()) for t in texts)


@F.pandas_udf(DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two token arrays, without junk heuristics."""
    return pd.Series([difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def minhash_matches(left: DataFrame, right: DataFrame, a: str, b: str, slots: int, least: float) -> DataFrame:
    """(a, b, agreement) of pairs of signatures (id, sig) of which a share `least` (over 0) of the slots is equal.

    Such pairs share a slot's value, so the join is on (slot, value) and the counts are the equal slots.
    """
    flat = lambda df, id: df.select(id, F.posexplode("sig").alias("slot", "value"))
    same = flat(left, a).join(flat(right, b), ["slot", "value"]).groupBy(a, b).agg((F.count(F.lit(1)) / slots).alias("agreement"))
    return same.where(F.col("agreement") >= least)


def block_keys(simhash: Column, most: int, spare: int, bits: int) -> tuple[list[Column], list[tuple[int, ...]]]:
    """The blocks of a hash that is cut into most + spare of them, and the choices of `spare` blocks: hashes that differ in `most` bits agree in one choice at least."""
    count = most + spare
    edges = [bits * k // count for k in range(count + 1)]
    blocks = [F.shiftright(simhash, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in itertools.pairwise(edges)]
    return blocks, list(itertools.combinations(range(count), spare))


def simhash_candidates(left: DataFrame, right: DataFrame, most: int = 4, spare: int = 2, bits: int = 60) -> DataFrame:
    """(h_a, n_a, h_b, n_b) of distinct (n, simhash) on either side that agree in `spare` of most + spare blocks, each pair once.

    One table per choice of blocks, all in one join on (choice, value): with the
    defaults 15 keys a hash, of 20 bits each, so D hashes and B others have D * B / 70,000
    candidates by chance, fewer with more spare blocks. A pair counts under the first
    choice that it agrees in, so none has to be made distinct.
    """

    def keyed(df, h, n):
        blocks, choices = block_keys(F.col(h), most, spare, bits)
        keys = F.array(*(F.xxhash64(F.lit(k), *(blocks[b] for b in chosen)) for k, chosen in enumerate(choices)))
        return df.select(F.col("simhash").alias(h), F.col("n").alias(n)).distinct().select(h, n, F.posexplode(keys).alias("choice", "key"))

    both = keyed(left, "h_a", "n_a").join(keyed(right, "h_b", "n_b"), ["choice", "key"])
    own, choices = block_keys(F.col("h_a").bitwiseXOR(F.col("h_b")), most, spare, bits)
    equal = [b == 0 for b in own]
    first = F.lit(len(choices))
    for k, chosen in reversed(list(enumerate(choices))):
        first = F.when(reduce(and_, (equal[b] for b in chosen)), F.lit(k)).otherwise(first)
    return both.where(first == F.col("choice")).select("h_a", "n_a", "h_b", "n_b")


def simhash_matches(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 4, least: int = 20, bits: int = 60, spare: int = 2) -> DataFrame:
    """(a, b, hamming) of pairs of (id, n, simhash) that differ in `most` bits at most, the larger set having `least` shingles.

    Distinct hashes are matched first, so copies of a text don't multiply candidates.
    """
    hamming = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))).cast("bigint").alias("hamming")
    pairs = simhash_candidates(left, right, most, spare, bits).where(F.greatest("n_a", "n_b") >= least).withColumn("hamming", hamming).where(F.col("hamming") <= most)
    mine = left.select(a, F.col("simhash").alias("h_a"), F.col("n").alias("n_a"))
    theirs = right.select(b, F.col("simhash").alias("h_b"), F.col("n").alias("n_b"))
    return pairs.join(mine, ["h_a", "n_a"]).join(theirs, ["h_b", "n_b"]).select(a, b, "hamming")


#: How many shingles count as hot at most, and how many pairs of rows one must make for that.
HOT, HOT_PAIRS = 1024, 10_000


def hot_shingles(left: DataFrame, right: DataFrame) -> list[int]:
    """Hashes of the shingles that most pairs of rows share, HOT at most; a page's frame is in nearly all pages."""
    rows = left.select(F.explode("s").alias("s"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(F.explode("s"), F.lit(0), F.lit(1)))
    counts = rows.groupBy("s").agg((F.sum("l") * F.sum("r")).alias("pairs")).where(F.col("pairs") >= HOT_PAIRS)
    return [r.s for r in counts.orderBy(F.desc("pairs"), "s").limit(HOT).collect()]


def bounded_overlap(left: DataFrame, right: DataFrame, a: str, b: str, jaccard: float, containment: float) -> DataFrame:
    """As set_overlap, of the pairs of sets (id, s: array of hashes) that reach either bound; no shingle makes a row, whoever shares it."""
    found = overlap.overlapping(left, right, a, b, jaccard, containment)
    sizes = F.col("shared"), F.col("n_a"), F.col("n_b")
    both = found.select("*", set_jaccard(*sizes).alias("jaccard"), set_containment(*sizes).alias("containment"))
    return both.where((F.col("jaccard") >= jaccard) | (F.col("containment") >= containment)).select(a, b, "n_a", "n_b", "shared", "jaccard", "containment")


def semantic_matches(left: DataFrame, right: DataFrame, a: str, b: str, key: str, jaccard: float = 0.45, containment: float = 0.75) -> DataFrame:
    """Pairs of rows (id, text, key) of equal keys whose shingle sets reach either bound."""

    def tagged(df, id):
        words = F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t))
        return df.select(id, overlap.gram_sets(words, F.xxhash64(key)).alias("s"))

    return bounded_overlap(tagged(left, a), tagged(right, b), a, b, jaccard, containment)


def set_jaccard(shared: F.Column, n_a: F.Column, n_b: F.Column) -> F.Column:
    """Jaccard similarity from the sizes; two empty sets are equal (1), an empty and another set share nothing (0)."""
    return F.when((n_a == 0) & (n_b == 0), 1.0).when((n_a == 0) | (n_b == 0), 0.0).otherwise(shared / (n_a + n_b - shared))


def set_containment(shared: F.Column, n_a: F.Column, n_b: F.Column) -> F.Column:
    """Share of the smaller set; 0 if either is empty."""
    return F.when((n_a == 0) | (n_b == 0), 0.0).otherwise(shared / F.least(n_a, n_b))
