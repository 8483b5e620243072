"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that stays in one shard. Groups go, largest
first, to the least-loaded shard, through a heap. Groups of one size are
interchangeable, so what is scheduled is the table of sizes and their counts,
streamed from the largest size down; all groups of a size are poured at once,
with the same loads as one heap step per group. Distinct sizes number at most
the square root of twice the bytes of all groups.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.sources.tables import materialize

#: Rows that one window ranks, on average; more are ranked in parts.
PART_ROWS = 1 << 16
#: Rows of a table that may be broadcast.
SMALL = 1 << 20


def pour(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of `size` each shard gets when each goes to the least-loaded one; updates loads.

    Ties go to the lowest shard number. Groups whose shard would start below
    the common level are dealt at once, the rest through the heap.
    """
    got = [0] * len(loads)
    if count > 2 * len(loads) and size > 0:
        below = lambda level: sum(max(0, -((load - level) // size)) for load in loads)  # noqa: E731  steps that start under the level
        lo, hi = min(loads), max(loads) + size * count + 1
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if below(mid) <= count else (lo, mid)
        for k, load in enumerate(loads):
            got[k] = max(0, -((load - lo) // size))
            loads[k] += got[k] * size
        count -= sum(got)
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        got[k] += 1
        loads[k] = load + size
    return got


def cuts(salts: list[tuple[int, int]], got: list[int]):
    """Rows (salt, lo, hi, shard) that hand the groups of each (salt, count), in order, to the shards, `got` of them to each."""
    shards = [[k, n] for k, n in enumerate(got) if n]
    for salt, n in salts:
        lo = 0
        while lo < n:
            take = min(shards[0][1], n - lo)
            yield salt, lo, lo + take, shards[0][0]
            lo += take
            shards[0][1] -= take
            if not shards[0][1]:
                shards.pop(0)


def schedule(shards: int):
    """A stream of (bytes, salt, groups), largest size first and its salts together, to (bytes, salt, lo, hi, shard): ranks lo <= r < hi of that size and salt go to the shard."""

    def run(batches):
        loads, out, size, salts = [0] * shards, [], None, []

        def dealt():
            got = pour(loads, size, sum(n for _, n in salts))
            return [(size, *cut) for cut in cuts(salts, got)]

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["bytes", "salt", "lo", "hi", "shard"]).cast(PLAN)

        for b in batches:
            for own, salt, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if own != size and salts:
                    out += dealt()
                    salts = []
                size = own
                salts.append((salt, n))
            if out:
                yield rows(out)
                out = []
        if salts:
            yield rows(dealt())

    return run


PLAN = pa.schema([("bytes", pa.int64()), ("salt", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("shard", pa.int32())])


def parts_of(rows: int | F.Column):
    """In how many parts so many rows are ranked."""
    return max(1, -(-rows // PART_ROWS)) if isinstance(rows, int) else F.ceil(rows / PART_ROWS)


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key, shard) for groups (key, bytes), one row per key: the longest-processing-time schedule, the lowest shard first on ties."""
    g = materialize(groups.select("key", "bytes"))
    # Sizes of very many groups are ranked in parts. These are one size in PART_ROWS groups at most.
    hot = materialize(g.groupBy("bytes").agg(parts_of(F.count(F.lit(1))).alias("parts")).where("parts > 1"))
    g = g.join(F.broadcast(hot) if hot.count() <= SMALL else hot, "bytes", "left")
    g = g.select("key", "bytes", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    sizes = g.groupBy("bytes", "salt").agg(F.count(F.lit(1)).alias("n"))
    # One task sees the table of sizes, never the groups.
    plan = sizes.repartition(1).sortWithinPartitions(F.desc("bytes"), "salt").mapInArrow(schedule(shards), "bytes long, salt int, lo long, hi long, shard int")
    ranked = g.withColumn("r", F.row_number().over(W.partitionBy("bytes", "salt").orderBy("key")) - 1)
    return ranked.join(plan, ["bytes", "salt"]).where("r >= lo and r < hi").select("key", "shard")


def with_slots(rows: DataFrame, shards_column: str, by: str, subs: int) -> DataFrame:
    """`rows` with `slot`, 0 to n - 1 within each shard; ranks run in `subs` parts of a shard side by side."""
    rows = rows.withColumn("sub", F.pmod(F.xxhash64(by, "nth"), F.lit(subs)).cast("int"))
    counts = rows.groupBy(shards_column, "sub").agg(F.count(F.lit(1)).alias("n"))
    # At most shards * subs rows, which is one in PART_ROWS rows and one per shard.
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(shards_column).orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(W.partitionBy(shards_column, "sub").orderBy(by, "nth"))
    return rows.withColumn("rank", rank).join(F.broadcast(before), [shards_column, "sub"]).withColumn("slot", F.col("before") + F.col("rank") - 1)


def shard(docs: DataFrame, shards: int = 24, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    Law `bytes`: near-equal bytes per shard, equal texts together (null counts
    as empty and costs 8 bytes). Repeated rows each get a slot of their own;
    null ids are dealt like any others. A group larger than a shard's fair
    share fills its shard alone. `grown_shard` is null: this law deals anew
    when the shard count changes. An empty table gives an empty table. Other
    columns are not read, whatever their names.
    """
    whole = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = materialize(
        docs.select(
            F.col(id).cast("long").alias("doc_id"),
            (F.octet_length(whole) + 8).cast("long").alias("size"),
            F.crc32(whole).alias("text_crc32"),
            F.unhex(F.sha2(whole, 256)).alias("key"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    groups = slim.groupBy("key").agg(F.sum("size").alias("bytes"))
    dealt = materialize(slim.join(materialize(shard_groups(groups, shards)), "key").select("doc_id", "size", "text_crc32", "shard", "nth"))
    subs = parts_of(-(-dealt.count() // shards))
    return with_slots(dealt, "shard", "doc_id", subs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 24 shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
