"""Brackets over ordered lines: matching by running depth, and folding nested rows from the deepest level up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.sources.tables import materialize


def matched_blocks(lines: DataFrame, file: str, line: str, opens: Column, closes: Column) -> DataFrame:
    """`lines` with block_depth and block_opener: how many blocks hold each line, and the line that opened the innermost of them.

    An opening and its closing line belong to their block. The running depth of
    a file numbers its levels; the last opener of a line's level is the one that
    holds it. A closing line without an opener counts for nothing.
    """
    order = W.partitionBy(file).orderBy(line).rowsBetween(W.unboundedPreceding, 0)
    move = F.when(opens, 1).when(closes, -1).otherwise(0)
    # The depth that never falls below zero: the plain sum less its least value so far.
    sums = lines.withColumn("_sum", F.sum(move).over(order))
    floor = F.least(F.lit(0), F.min("_sum").over(order))
    depth = F.col("_sum") - floor
    # A closing line that fell through the floor has no block.
    falls = closes & (F.col("_sum") < F.coalesce(F.least(F.lit(0), F.min("_sum").over(order.rowsBetween(W.unboundedPreceding, -1))), F.lit(0)))
    held = sums.withColumn("block_depth", F.when(closes & ~falls, depth + 1).otherwise(depth).cast("int"))
    level = W.partitionBy(file, "block_depth").orderBy(line).rowsBetween(W.unboundedPreceding, 0)
    opener = F.last(F.when(opens, F.col(line)), ignorenulls=True).over(level)
    return held.withColumn("block_opener", F.when(F.col("block_depth") > 0, opener)).drop("_sum")


def without_blocks(lines: DataFrame, file: str, line: str, opens: Column, closes: Column, unwanted: Column) -> DataFrame:
    """`lines` with `gone`: whether a line is in a block whose opening line is unwanted, at any depth; and `cut`, whether it opens such a block that no other one holds.

    Unwanted blocks are intervals of lines: a line is gone while more of them have begun than have ended.
    """
    blocks = matched_blocks(lines.withColumn("_bad", opens & unwanted), file, line, opens, closes)
    # Every closing line knows its opener; whether that one was unwanted is the last such flag of its level.
    level = W.partitionBy(file, "block_depth").orderBy(line).rowsBetween(W.unboundedPreceding, 0)
    own = F.last(F.when(opens, F.col("_bad")), ignorenulls=True).over(level)
    blocks = blocks.withColumn("_ends", F.coalesce(closes & (F.col("block_depth") > 0) & own, F.lit(False)))
    before = W.partitionBy(file).orderBy(line).rowsBetween(W.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col("_ends").cast("int")).over(before), F.lit(0))
    begun = F.sum(F.col("_bad").cast("int")).over(W.partitionBy(file).orderBy(line).rowsBetween(W.unboundedPreceding, 0))
    open_bad = begun - ended
    return blocks.withColumns({"gone": open_bad > 0, "cut": F.col("_bad") & (open_bad == 1)}).drop("_bad", "_ends")


def assembled(rows: DataFrame, tree: str, id: str, parent: str, order: str, head: str, tail: str, indent: str = "  ") -> DataFrame:
    """(tree, text) of nested rows: each row's head, what is below it one step further in, and its tail (if not null), in lines; siblings by `order`, then id.

    Rows without a parent are the tops. Levels are found from the tops down, as many
    as there are, and folded from the deepest up: one aggregation of the children's
    texts by parent for each level. Ids are those of one tree; a row whose parents
    lead to no top (to a missing row, or in a circle) is in no text. A tree's text is one
    row, so it has to fit one task.
    """
    # Every level reads the rows, so they are worked out once.
    slim = materialize(rows.select(tree, id, parent, order, head, tail))
    levels = [slim.where(F.col(parent).isNull())]
    while True:
        below = materialize(slim.join(levels[-1].select(tree, F.col(id).alias(parent)), [tree, parent]).select(*slim.columns))
        if below.isEmpty():
            break
        levels.append(below)
    body = None
    for own in reversed(levels):
        within = own.withColumn("_body", F.lit(None).cast("string")) if body is None else own.join(body, [tree, id], "left")
        shifted = F.regexp_replace("_body", "(?m)^", indent)
        line = F.struct(F.col(order).alias("o"), F.col(id).alias("i"), F.concat_ws("\n", head, shifted, tail).alias("t"))
        lines = within.select(tree, F.col(parent).alias("_up"), line.alias("_line"))
        body = lines.groupBy(tree, "_up").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["t"]), "\n").alias("_body")).withColumnRenamed("_up", id)
    return body.select(tree, F.col("_body").alias("text"))
