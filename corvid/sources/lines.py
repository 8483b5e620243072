"""Readers of line and document files. Nothing but file names and schemas reaches the driver."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corvid.operators.ordering import running_index
from corvid.sources.tables import exists, materialize


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value): every line of text or gzip files with its number in its file, from 1.

    Files are read in blocks side by side. A line's number is its place in its
    block after the lines of the file's blocks before it. Bytes that are no UTF-8
    become U+FFFD.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"))
    # Ids ascend along each block; they are written once, so that ranks and counts agree.
    rows = materialize(raw.withColumn("at", F.monotonically_increasing_id()))
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A block's rows lie in one partition without a gap in their ids.
    return rows.join(before.drop("n"), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def jsonl_schema(spark: SparkSession, paths: str | list[str]) -> StructType:
    """The schema of JSONL files, by Spark's own reader."""
    fields = spark.read.json(paths).schema.fields
    return StructType([f for f in fields if f.name != "_corrupt_record"])


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str | None = None, bad: str = "fail") -> DataFrame:
    """(file, line, then the fields) of JSONL files, gzip included; blank lines are skipped.

    A line that is no JSON object of the schema's types is an error that names file and line
    (`bad` = fail), is left out (skip), or has null fields (keep). A missing field is null.
    """
    if bad not in ("fail", "skip", "keep"):
        raise ValueError(f"unknown way with bad lines: {bad}")
    schema = schema or jsonl_schema(spark, paths)
    fields = StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    lines = numbered_lines(spark, paths).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    parsed = lines.withColumn("r", F.from_json("value", StructType([*fields, StructField("_corrupt", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    whole = F.rlike("value", F.lit(r"^\s*\{")) & F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    if bad == "fail":
        where = F.concat(F.lit("no JSON object of the schema: "), "file", F.lit(":"), F.col("line").cast("string"))
        parsed = parsed.withColumn("r", F.when(whole, F.col("r")).otherwise(F.raise_error(where)))
    elif bad == "skip":
        parsed = parsed.where(whole)
    else:
        parsed = parsed.withColumn("r", F.when(whole, F.col("r")))
    return parsed.select("file", "line", *(F.col("r")[f.name].alias(f.name) for f in fields))


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last by `order`; partial results are merged before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns))


def read_problems(spark: SparkSession, paths: str | list[str], key: str = "task_id", when: Column | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Rows that `when` holds for, the last line of each key."""
    rows = read_jsonl(spark, paths, schema)
    return last_wins(rows.where(when) if when is not None else rows, [key], ["file", "line"])


def validated(rows: DataFrame, required: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """`rows` as they are, but an error for a null or blank required field, and defaults for null or missing fields."""
    missing = F.concat_ws(", ", *(F.when(F.btrim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required))
    checked = {c: F.when(missing == "", F.col(c)).otherwise(F.raise_error(F.concat(F.lit("required field is missing: "), missing))) for c in required}
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in (defaults or {}).items()}
    return rows.withColumns({**checked, **filled})


def read_splits(spark: SparkSession, splits: dict[str, str], schema: StructType | str | None = None, dataset: str = "core", fields: dict[str, list[str]] | None = None) -> DataFrame:
    """The union of JSONL files tagged with dataset, split and 1-based row_index.

    `fields` names output columns and where each comes from: the first of these columns that is there and not empty, else ''.
    """
    parts = []
    for split, path in splits.items():
        rows = read_jsonl(spark, path, schema).withColumnRenamed("line", "row_index").drop("file")
        found = {name: F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in some if c in rows.columns), F.lit("")) for name, some in (fields or {}).items()}
        parts.append(rows.withColumns({"dataset": F.lit(dataset), "split": F.lit(split), **found}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_benchmarks(spark: SparkSession, benchmarks: dict[str, tuple[str, dict[str, list[str]]]], schema: StructType | str | None = None, intrinsic: str = "SVE") -> DataFrame:
    """Rows of several benchmarks in one shape, split `benchmark`: for each its file and the fields as in `read_splits`.

    A row that names another intrinsic than the asked one (in any case) is left out; one that names none stays.
    """
    out = None
    for name, (path, fields) in benchmarks.items():
        rows = read_splits(spark, {"benchmark": path}, schema, name, fields)
        if "intrinsic" in rows.columns:
            named = F.coalesce(F.col("intrinsic").cast("string"), F.lit(""))
            rows = rows.where((named == "") | (F.upper(named) == intrinsic))
        rows = rows.select("dataset", "split", "row_index", *fields)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_items(spark: SparkSession, splits: dict[str, str], schema: StructType | str | None = None, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of all splits with `_idx`, their number from 1 on over the splits as they are named and their lines."""
    rank = F.lit(len(splits))
    for k, split in enumerate(splits):
        rank = F.when(F.col("split") == split, F.lit(k)).otherwise(rank)
    rows = read_splits(spark, splits, schema, fields=fields).withColumn("_rank", rank)
    return running_index(rows, ["_rank", "row_index"], "_idx")[0].withColumn("_idx", F.col("_idx") + 1).drop("_rank")


def in_input_order(rows: DataFrame, first: str = "train") -> DataFrame:
    """Rows by split, `first` before the others, then by line."""
    return rows.orderBy(F.col("split") != first, "split", "row_index")


def files_under(spark: SparkSession, paths: list[str], pattern: str = r"\.json$") -> DataFrame:
    """(path, length) of files: one that is named as it is, and those under a folder, at any depth, whose name fits `pattern`; missing paths are left out."""
    out, jvm, conf = None, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in (p for p in paths if exists(spark, p)):
        at = jvm.org.apache.hadoop.fs.Path(path)
        folder = at.getFileSystem(conf).getFileStatus(at).isDirectory()
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
        found = found.where(F.rlike(F.element_at(F.split("path", "/"), -1), F.lit(pattern))) if folder else found
        out = found if out is None else out.unionByName(found)
    return out.distinct() if out is not None else spark.createDataFrame([], "path string, length long")


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, text): every file under `paths`, at any depth, as one row; a file has to fit in a worker's memory."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_json_documents(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """(file, document): each file parsed as one JSON document, null where it is none."""
    return whole_files(spark, paths).select("file", F.from_json("text", schema).alias("document"))


@F.pandas_udf(ArrayType(StringType()))
def json_sequence(texts: pd.Series) -> pd.Series:
    """The JSON documents that stand one after another in a text, up to the first place where none begins."""
    decoder, out = json.JSONDecoder(), []
    for text in texts:
        found, at, text = [], 0, text or ""
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            try:
                _, end = decoder.raw_decode(text, at)
            except ValueError:
                break
            found.append(text[at:end])
            at = end
        out.append(found)
    return pd.Series(out)


def read_concatenated_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ordinal, document): all JSON documents of each file, in order, as text."""
    found = whole_files(spark, paths).select("file", json_sequence("text").alias("l"))
    return found.select("file", F.posexplode("l").alias("ordinal", "document"))


def read_tasks(spark: SparkSession, path: str, required: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """(complete, incomplete): a row for each folder under `path` named `prefix` and a number.

    Complete ones have a column for each required file (its name without extension), and
    come by their number, names without one last; incomplete ones tell the files they lack.
    """
    parts = F.split("file", "/")
    files = whole_files(spark, path).select(F.element_at(parts, -2).alias("task"), F.element_at(parts, -1).alias("name"), "text").where(F.startswith("task", F.lit(prefix)))
    wide = files.groupBy("task").pivot("name", required).agg(F.first("text"))
    lacks = F.filter(F.array(*(F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n in required)), lambda x: x.isNotNull())
    number = F.substr("task", F.lit(len(prefix) + 1)).try_cast("bigint")
    complete = wide.where(F.size(lacks) == 0).orderBy(F.asc_nulls_last(number), "task")
    return complete.select("task", *(F.col(f"`{n}`").alias(n.rsplit(".", 1)[0]) for n in required)), wide.where(F.size(lacks) > 0).select("task", F.array_join(lacks, ", ").alias("missing"))
