"""Readers of the benchmark tables and the shared-storage checkpoint helper."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt evenly over some tasks for each core: a small file is one task or few, however much work its rows are.

    No more than that, as a task that first sets up large expressions costs by itself.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only in a session of one process (tests), and only where that is unset, a
    temporary folder of this machine serves; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="corvid-checkpoint-")


def file_system(spark: SparkSession, path: str):
    """(file system, JVM, its configuration) of a path of any kind that Spark can open."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf), jvm, conf


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    fs, jvm, _ = file_system(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    fs, jvm, _ = file_system(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path))


def create(spark: SparkSession, path: str, text: str) -> None:
    """A small file."""
    fs, jvm, _ = file_system(spark, path)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path))
    out.write(bytearray(text.encode()))
    out.close()


def replace(spark: SparkSession, path: str, new: str) -> None:
    """Gives a file or folder a new name; what had that name goes."""
    fs, jvm, _ = file_system(spark, path)
    to = jvm.org.apache.hadoop.fs.Path(new)
    fs.delete(to, True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(path), to):
        raise OSError(f"{path} could not be renamed to {new}")


def materialize(df: DataFrame) -> DataFrame:
    """`df` written to the reliable checkpoint folder; lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    # What led to `out` is not needed again. Spark removes shuffle files once the
    # driver has collected the garbage that refers to them.
    gc.collect()
    sc._jvm.System.gc()
    return out
