"""A bounded choice of the most frequent rows of a count table, without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_cut(counts: DataFrame, column: str, most: int) -> int:
    """The smallest bound on a bucket's edge that at most `most` rows of positive counts reach.

    Buckets are sixteenths of a power of two, so the driver sees about a
    thousand rows at most.
    """
    bucket = F.floor(F.log2(F.col(column).cast("double")) * 16).alias("b")
    rows = counts.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo")).collect()
    cut, taken = None, 0
    for r in sorted(rows, key=lambda r: -r.b):
        if taken + r.n > most:
            return cut if cut is not None else r.lo + (1 << 62)
        taken, cut = taken + r.n, r.lo
    return cut if cut is not None else 1
