"""The corpus pipeline: documents from raw to sharded.

Each stage takes (spark, docs, sf_dir) and returns a frame; every stage works
on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import decontaminate, language_id, mixing, ngram_join, sharding
from corvid.llm.frames import small_batches, unused
from corvid.sources.tables import exists, remove, shared_folder, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those that are null or have no letter go.

    The automata are fitted on the labelled documents outside the held-out fold;
    without a labelled document no language can be told and all go. Texts are read
    whole. Repeated rows share their fate. An empty table gives an empty one. All
    columns pass unchanged, whatever their names.
    """
    small_batches(spark)
    model = language_id.fit(docs.where(~language_id.held_out()))
    told, score = unused(docs, "told", "score")
    return language_id.identify(docs, model, lang_pred=told, score=score).where(F.col(told) != language_id.UNDETERMINED).drop(told, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates.

    As near-duplicate stages do, it takes five-word shingles and a similarity
    of 0.8 or more. Documents without words, and rows of a null id, are near
    nothing and stay. Rows of one id stay or go together. An empty table gives an
    empty one. All columns pass unchanged, whatever their names.
    """
    small_batches(spark)
    return ngram_join.one_of_each(docs, width=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs.

    Null and empty texts hold none and stay, and so does everything if the
    benchmark is empty. Repeated rows share their fate. All columns pass
    unchanged, whatever their names.
    """
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample of documents that meets the target weights.

    Null source or language is a value of its own. Null and empty texts weigh
    nothing and stay with the probability of the asked share. Repeated rows share
    their fate. An empty table gives an empty one. All columns pass unchanged; one
    named like an inner mix_ column does too.
    """
    small_batches(spark)
    inner = [c for c in docs.columns if c.lower().startswith("mix_")]
    aside = dict(zip(inner, unused(docs, *(f"kept_{c}" for c in inner)), strict=True))
    mixed = mixing.mix(docs.withColumnsRenamed(aside)).where("mix_kept")
    return mixed.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every remaining document.

    Equal texts share a shard; null counts as empty. Repeated rows get a slot
    each, null ids too. An empty table gives an empty one. Other columns are not read.
    """
    small_batches(spark)
    return sharding.shard(docs)


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
    ("sharding", shards),
]

#: SQL can express neither the trained models nor the greedy schedule; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """All stages over `documents`; what each returns is written in the shared folder and read again.

    A run that is given the `base` of one that broke off goes on after its last whole
    stage. A stage's files are removed once the next stage's are whole, so only those
    of the last one stay.
    """
    docs = table(spark, sf_dir, "documents")
    base = base or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{base}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    whole = [exists(spark, f"{p}/_SUCCESS") for p in paths]
    first = max((k + 1 for k, ok in enumerate(whole) if ok), default=0)
    if first:
        docs = spark.read.parquet(paths[first - 1])
    for k in range(first, len(STAGES)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            remove(spark, paths[k - 1])
    return docs
