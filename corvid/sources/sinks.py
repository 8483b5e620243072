"""Writers. Files come in parts, as a cluster writes them; `joined` puts those of a folder into one file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvid.sources.tables import create, file_system, replace

#: Rows that a summary may bring to the driver.
SUMMARY_ROWS = 10_000


def tsv_text(c: Column, escape: bool) -> Column:
    """A cell: line breaks written as two characters (escape), or tabs and line breaks as blanks."""
    c = c.cast("string")
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if escape else F.regexp_replace(c, r"[\t\r\n]", " ")


def write_tsv(df: DataFrame, path: str, fields: list[str] | None = None) -> int:
    """Tab-separated text with a header; the number of rows. With `fields`, those columns, missing ones empty, and no tab or line break in a cell; else all columns, line breaks escaped. An empty table leaves no row and no header.

    A folder of parts: put together in the order of their names they are the
    table, the header first, in the order of `df`. Every task writes its own part
    next to `path`; the folder takes its name once all parts and the header are there.
    """
    names = fields or df.columns
    cells = [tsv_text(F.col(c) if c in df.columns else F.lit(""), fields is None) for c in names]
    lines = df.select(F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in cells)).alias("value"))
    held = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows = counted(lines, lambda x: x.write.text(held))
    if rows:
        # Spark's own names begin with part-00000-, and so come after this one.
        create(df.sparkSession, f"{held}/part-00000", "\t".join(names) + "\n")
    replace(df.sparkSession, held, path)
    return rows


def joined(spark: SparkSession, path: str, file: str) -> None:
    """The parts of a folder of text, in order, as one file of an exact name: the file system's streams are copied one after the other, in constant memory."""
    fs, jvm, conf = file_system(spark, path)
    target = file_system(spark, file)[0]
    parts = sorted(str(s.getPath()) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if s.getPath().getName().startswith("part-"))
    held = f"{file}.{uuid.uuid4().hex}"
    out = target.create(jvm.org.apache.hadoop.fs.Path(held))
    for p in parts:
        source = fs.open(jvm.org.apache.hadoop.fs.Path(p))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        source.close()
    out.close()
    replace(spark, held, file)


def counted(df: DataFrame, write) -> int:
    """The rows that `write`, a function of a frame, has written: counted while it runs."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def write_jsonl(df: DataFrame, path: str, sort_keys: bool = False, append: bool = False, gzip: bool = False, one_file: bool = False) -> int:
    """One JSON object per line, nulls kept; the number of rows written. Keys of the outermost object come in order with `sort_keys`."""
    df = df.select(*(F.col(f"`{c}`") for c in (sorted(df.columns) if sort_keys else df.columns)))
    out = df.coalesce(1) if one_file else df
    return counted(out, lambda x: x.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").option("compression", "gzip" if gzip else "none").json(path))


def write_json(value, path: str, spark) -> None:
    """A small value of the driver as one indented JSON document."""
    text = json.dumps(value, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_features(df: DataFrame, path: str, dataset: str = "dataset") -> None:
    """Feature rows as JSONL, a folder for each dataset."""
    df.repartition(dataset).write.mode("overwrite").partitionBy(dataset).json(path)


def markdown_summary(title: str, counters: dict[str, DataFrame]) -> str:
    """A section for each table of counters (two columns or more); these are small, and a larger one is an error."""
    out = [f"# {title}"]
    for name, df in counters.items():
        rows = df.limit(SUMMARY_ROWS + 1).collect()
        if len(rows) > SUMMARY_ROWS:
            raise ValueError(f"{name}: a summary has {SUMMARY_ROWS} rows at most")
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def write_outputs(outputs: dict[str, DataFrame], base: str) -> dict[str, int]:
    """Each table as JSONL under `base`, then a manifest of their row counts."""
    counts = {}
    for name, df in outputs.items():
        counts[name] = write_jsonl(df, f"{base}/{name}.jsonl")
        spark = df.sparkSession
    if counts:
        write_json({"outputs": counts, "rows": sum(counts.values())}, f"{base}/manifest.json", spark)
    return counts


def merged_shards(shards: dict[int, DataFrame], order: str) -> DataFrame:
    """All shards' rows in shard order, then by `order`; a number without a shard is skipped."""
    out = None
    for k, df in shards.items():
        part = df.withColumn("shard", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("shard", order) if out is not None else None
