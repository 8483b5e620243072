"""Evaluation metrics over sample results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_ordinal(df: DataFrame, task: str, *order: str, name: str = "ordinal") -> DataFrame:
    """`df` with the 0-based ordinal of each row in its task."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(task).orderBy(*order)).cast("bigint") - 1)


def pass_at(n: Column, c: Column, k: int) -> Column:
    """1 where n - c < k, else 1 minus the product over i = n - c + 1 .. n of 1 - k / i."""
    misses = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - misses)


def pass_at_k(results: DataFrame, task: str, passed: str, ks: tuple[int, ...] = (1, 5), padded_to: int = 5) -> DataFrame:
    """(k, pass_at_k) averaged over tasks; a k appears only if every task has k samples. Tasks are padded with failures."""
    per_task = results.groupBy(task).agg(F.greatest(F.count(F.lit(1)), F.lit(padded_to)).alias("n"), F.count_if(passed).alias("c"))
    least = F.min("n").alias("least")
    sums = per_task.agg(least, *(F.avg(pass_at(F.col("n"), F.col("c"), k)).alias(f"k{k}") for k in ks))
    rows = F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"k{k}").alias("v")) for k in ks))
    return sums.select("least", F.inline(rows)).where(F.col("k") <= F.col("least")).select("k", F.round("v", 6).alias("pass_at_k"))


def trimmed_mean(values: Column, cut: float = 0.2) -> Column:
    """Mean without the floor(n * cut) smallest and largest of an array; the plain mean if none is left."""
    n, drop = F.size(values), F.floor(F.size(values) * cut).cast("int")
    kept = F.slice(F.array_sort(values), drop + 1, n - 2 * drop)
    use = F.when(F.size(kept) > 0, kept).otherwise(values)
    return F.aggregate(use, F.lit(0.0), lambda a, x: a + x) / F.size(use)


def trimmed_means(df: DataFrame, by: str, value: str, cut: float = 0.2) -> DataFrame:
    """(by, trimmed): the mean of each group without its floor(n * cut) smallest and largest values, by ranks; a group of any size is never one array."""
    sizes = df.groupBy(by).agg(F.count(value).alias("n")).select(by, "n", F.floor(F.col("n") * cut).alias("drop"))
    ranked = df.where(F.col(value).isNotNull()).select(by, value, F.row_number().over(W.partitionBy(by).orderBy(value)).alias("k"))
    # Where nothing would be left, all is kept.
    inside = (F.col("n") <= 2 * F.col("drop")) | ((F.col("k") > F.col("drop")) & (F.col("k") <= F.col("n") - F.col("drop")))
    return ranked.join(sizes, by).where(inside).groupBy(by).agg(F.avg(value).alias("trimmed"))


def fixed_domain_counts(df: DataFrame, by: str, column: str, domain: list[str]) -> DataFrame:
    """Counts of each value of a fixed domain per group, zero-filled; other values are left out."""
    return df.groupBy(by).pivot(column, domain).count().fillna(0)
