"""Exact deduplication: sorted digest runs merged along a tree of partitions.

Every partition first makes a sorted run of its digests. Then partitions
exchange runs in binomial rounds: in round r, the two nodes that differ only
in bit r of their number trade the parts of their runs that belong to the
other's bit of the digest, and each merges, in one multiway pass, what it got
with what it kept. Equal texts become one row at every level, which retains
the best identifier, so a class of any size is one row per node from the first
run on. After the last round a node holds the whole class of each digest that
it owns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.sources.tables import materialize

RUN = "node int, digest string, bytes long, crc long, keep long, rows long"
#: Digests that a node should own; nodes are a power of two, and MOST_NODES at most.
NODE_ROWS = 1 << 15
MOST_NODES = 1 << 13


def merge_sorted(batches):
    """Adjacent equal (node, digest, bytes, crc) of a sorted run become one row: rows add up, the best identifier stays.

    A digest is taken as the same text only if byte length and crc32 agree
    too. The last class of a batch is held back until the next one, so a class
    may span any number of batches in constant memory.
    """
    keys = ["node", "digest", "bytes", "crc"]
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        t = t.group_by(keys, use_threads=False).aggregate([("keep", "max"), ("rows", "sum")])
        t = t.rename_columns([*keys, "keep", "rows"]).select(["node", "digest", "bytes", "crc", "keep", "rows"])
        held = t.slice(t.num_rows - 1)
        if t.num_rows > 1:
            yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def merged(runs: DataFrame, nodes: int) -> DataFrame:
    """One level of the tree: runs sent to their nodes, one task each, sorted, merged."""
    order = ["node", "digest", "bytes", "crc"]
    return runs.repartitionById(nodes, "node").sortWithinPartitions(*order).mapInArrow(merge_sorted, RUN)


def tree_nodes(rows: int) -> int:
    """The power of two at or above rows / NODE_ROWS, MOST_NODES at most."""
    return min(MOST_NODES, 1 << max(0, -(-rows // NODE_ROWS) - 1).bit_length())


def digest_classes(rows: DataFrame, smallest: bool = True, nodes: int | None = None) -> DataFrame:
    """Classes (digest, bytes, crc, keep, rows) of rows (digest, bytes, crc, id), by tree-merge over `nodes` (a power of two; None: by the number of rows).

    `smallest` picks the identifier that a class retains; null identifiers
    lose against any other, and a class of nulls retains null.
    """
    nodes = nodes or tree_nodes(rows.count())
    # The largest of the complements is that of the smallest identifier; unlike negation it holds for every long.
    turned = F.bitwise_not if smallest else lambda c: c
    node = F.spark_partition_id() % nodes
    run = rows.select(node.cast("int").alias("node"), "digest", "bytes", "crc", turned(F.col("id")).alias("keep"), F.lit(1).cast("long").alias("rows"))
    # The first run: what one partition holds, merged where it lies.
    run = run.sortWithinPartitions("node", "digest", "bytes", "crc").mapInArrow(merge_sorted, RUN)
    owner = F.conv(F.substring("digest", 1, 6), 16, 10).cast("int")
    for bit in (1 << r for r in range(nodes.bit_length() - 1)):
        run = merged(run.withColumn("node", F.col("node").bitwiseAND(F.lit(~bit)).bitwiseOR(owner.bitwiseAND(F.lit(bit)))), nodes)
    if nodes == 1:
        run = merged(run, 1)
    return run.select("digest", "bytes", "crc", turned(F.col("keep")).alias("keep"), "rows")


def digests(docs: DataFrame, text: Column, id: str = "doc_id") -> DataFrame:
    """(id, digest, bytes, crc) of every row; a null text counts as empty."""
    whole = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return docs.select(F.col(id).cast("long").alias("id"), F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("bytes"), F.crc32(whole).alias("crc"))


def exact_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, and empty texts are
    equal to each other. Of equal texts the row with the smallest (or largest)
    id stays. Repeated rows with that same id all count in group_size and are
    all kept. A null id loses against any other; in a class of null ids the
    rows are kept. An empty table gives an empty table. Other columns are not
    read, whatever their names.
    """
    slim = materialize(digests(docs, F.col(text), id))
    classes = digest_classes(slim, smallest=keep == "smallest").where("rows > 1")
    on = ["digest", "bytes", "crc"]
    return slim.join(classes, on, "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("keep", "id").eqNullSafe(F.col("id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts over all `documents`; the largest doc_id stays."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


SQL = {
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)"""
}
