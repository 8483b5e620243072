"""Ordered and interval operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.sources.tables import materialize


def enclosing(items: DataFrame, key: str, begin: str, end: str, id: str, cell: int) -> DataFrame:
    """Pairs (id, parent, width): intervals of the same key that strictly contain another one.

    Begins are dealt into cells of `cell` units; an interval visits the cells
    that it covers, so the join is an equi-join on (key, cell) with a residual.
    """
    outer = items.select(F.col(key).alias("k"), F.col(id).alias("parent"), F.col(begin).alias("pb"), F.col(end).alias("pe"))
    outer = outer.withColumn("cell", F.explode(F.sequence(F.floor(F.col("pb") / cell), F.floor(F.col("pe") / cell))))
    inner = items.select(F.col(key).alias("k"), F.col(id).alias("id"), F.col(begin).alias("b"), F.col(end).alias("e"), F.floor(F.col(begin) / cell).alias("cell"))
    inside = (F.col("pb") <= F.col("b")) & (F.col("e") <= F.col("pe")) & (F.col("pe") - F.col("pb") > F.col("e") - F.col("b"))
    return inner.join(outer, ["k", "cell"]).where(inside).select("id", "parent", (F.col("pe") - F.col("pb")).alias("width"))


def previous_match(df: DataFrame, key: list[str], order: list[str], when: Column, value: Column, name: str) -> DataFrame:
    """As-of: the latest earlier row of the same key for which `when` holds gives `value`; no such row: null."""
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(before))


def islands(df: DataFrame, key: str, order: list[str], value: str, name: str = "island") -> DataFrame:
    """`df` with the 0-based number of the run of equal values that a row is in."""
    w = W.partitionBy(key).orderBy(*order)
    new = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("bigint")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_new")


def first_crossing(df: DataFrame, key: str, order: list[str], amount: Column, threshold) -> DataFrame:
    """Of each key, the first row at which the running total of `amount` passes the threshold."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = df.withColumn("running", F.sum(amount).over(w)).where(F.col("running") > threshold)
    return run.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def running_index(df: DataFrame, order: list[str], name: str = "index") -> tuple[DataFrame, int]:
    """`df` with each row's 0-based place in the order of all rows, and their number; rows that tie get places in some order.

    Ranks come from range partitions: counts per partition are few, and each row
    is ranked within its own, so no task orders all rows.
    """
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    # One row per partition.
    ranked = ranged.withColumn("_r", rank).join(F.broadcast(before), "_p")
    return ranked.withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_r", "_before"), ranged.count()


def contiguous_shards(df: DataFrame, order: str, shards: int) -> DataFrame:
    """`df` with the shard of ceil(n / shards) consecutive rows that each is in."""
    placed, total = running_index(df, [order], "_at")
    size = max(1, -(-total // shards))
    return placed.withColumn("shard", F.expr(f"_at div {size}")).drop("_at")
