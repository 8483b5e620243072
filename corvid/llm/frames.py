"""Schemas of frames that Python workers extend."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


def extended(df: DataFrame, **columns: DataType) -> StructType:
    """The schema of `df`, all nullable, followed by `columns`."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + [StructField(k, v) for k, v in columns.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores after it as `df` needs to have no column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def release() -> None:
    """Gives memory that a worker has freed back to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of a batch of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python workers in batches of BATCH_BYTES, not of up to 10,000 rows and 64 MB: batches of whole texts are held by the executor and by its worker, going in and coming out."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run):
    """`run`, a function on a stream of batches, that releases memory after its last batch."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole
