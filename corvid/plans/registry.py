"""Where queries register: the Spark function by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corvid.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shared(name: str, sql: str) -> None:
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = name
    QUERIES[name], SQL[name] = run, re.sub(r"\{(\w+)\}", r"\1", sql)
