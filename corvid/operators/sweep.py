"""Sweeps: one pass over events in order, with a stack of the intervals that are open."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.sources.tables import materialize


def open_intervals(intervals: DataFrame, points: DataFrame, key: str, begin: str, end: str, id: str, at: str, point: str, parts: int | None = None) -> DataFrame:
    """(point, interval, level): the intervals [begin, end] of a point's key that hold it, level 0 the innermost.

    That is the one that begins last; of those the one that ends first, then the
    larger id. `id` and `point` are bigints, as are places; rows with a null in
    any of these columns take no part. Intervals may overlap as they like.

    Events go in ranges of (key, place) to `parts` tasks, so that a key of any
    size is spread. What is open at the end of a range is carried to every later
    one that it reaches into, which is at most the nesting depth for each range.
    One sort orders a range; its task holds the open intervals.
    """
    cols = lambda df, *c: df.select(*(F.col(x).alias(y) for x, y in c)).dropna()
    i = cols(intervals, (key, "k"), (begin, "pos"), (end, "until"), (id, "id")).where("until >= pos").withColumn("kind", F.lit(1))
    p = cols(points, (key, "k"), (at, "pos"), (point, "id")).withColumns({"until": F.col("pos"), "kind": F.lit(2)})
    events = i.unionByName(p).select("k", F.col("pos").cast("long"), F.col("until").cast("long"), F.col("id").cast("long"), "kind")
    by = ["k", "pos", "kind"]
    ranged = materialize((events.repartitionByRange(parts, *by) if parts else events.repartitionByRange(*by)).withColumn("part", F.spark_partition_id()))
    # A key whose rows are in several ranges has one row for each of them here.
    spans = ranged.groupBy("part", "k").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    ends = spans.select("part", "k", "last")
    left = ranged.where("kind = 1").join(ends, ["part", "k"]).where("until >= last").select("k", "until", "id", F.col("pos").alias("since"), F.col("part").alias("of"))
    carried = left.join(spans.select("part", "k", "first"), "k").where("part > of AND first <= until").select("k", F.col("first").alias("pos"), "until", "id", F.lit(0).alias("kind"), "part", "since")
    whole = ranged.withColumn("since", F.col("pos")).unionByName(carried)
    count = ranged.rdd.getNumPartitions()
    ordered = whole.repartitionById(count, "part").sortWithinPartitions("k", "pos", "kind", "since", F.desc("until"), "id")

    def sweep(batches):
        key, open = None, []
        for b in batches:
            found = []
            for k, pos, until, id, kind in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if k != key:
                    key, open = k, []
                while open and open[-1][0] < pos:
                    open.pop()
                if kind < 2:
                    open.append((until, id))
                    continue
                if open and any(u < pos for u, _ in open):
                    open = [x for x in open if x[0] >= pos]  # one that overlaps its successor ends below it
                found += [(id, x, level) for level, (_, x) in enumerate(reversed(open))]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["point", "interval", "level"])

    return ordered.select("k", "pos", "until", "id", "kind").mapInArrow(sweep, "point long, interval long, level int")
