"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.sources.tables import materialize

#: Links that one task of a round takes.
TASK_LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots themselves, from links (u, v); root is the smallest node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest neighbour; nothing but the table's fingerprint reaches the
    driver. Joins spread a node of very many neighbours like any skewed key.
    What a round writes has a file for each TASK_LINKS links, not for each
    shuffle partition, as its links are few against the documents.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    parts = before[0] // TASK_LINKS + 1
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).repartition(parts, "u", "v").distinct())
        now = print_of(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
