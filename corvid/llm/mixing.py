"""Mixing sources to target weights by iterative proportional fitting.

Token totals of (source, language, topic) cells are raked until the marginals
of source, language and topic meet their targets; a cell's fitted total over
its own total is the weight of its documents' tokens. Documents are then kept
with probabilities proportional to the weights, calibrated so that the
expected number of kept tokens is the asked share of the corpus.

A topic is a column of the table, or the class that a spherical k-means over
the word profiles of all documents gives. All its sums are of whole numbers,
so topics depend neither on the order nor on the partitions of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from corvid.llm.frames import extended, tidy, unused
from corvid.llm.textbytes import flat, slices, words
from corvid.sources.tables import materialize

TOPICS = 8
#: Hash bins of a word profile, and rounds of the k-means.
BINS, ROUNDS = 64, 3
#: Cells that the driver rakes in numpy; a larger table is raked by Spark.
DRIVER_CELLS = 200_000


def profiles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, profile) of every text; null counts as empty.

    A profile has, for each of BINS classes that words of five bytes or more
    fall into by hash, 100 times the root of its share of those words: all
    profiles are of one length, or zero.
    """
    tokens, out = [np.zeros(0, np.int64)], [np.zeros((0, BINS), np.int8)]
    for lo, hi in slices(column):
        hashed, length, _, n = words(*flat(column.slice(lo, hi - lo)))
        row = np.repeat(np.arange(hi - lo), n)
        long = length >= 5
        counts = np.bincount(row[long] * BINS + (hashed[long] % np.uint64(BINS)).astype(np.int64), minlength=(hi - lo) * BINS).reshape(-1, BINS)
        tokens.append(n)
        out.append(np.rint(100 * np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))).astype(np.int8))
    return np.concatenate(tokens), np.concatenate(out)


def topics_of(profile: np.ndarray, tokens: np.ndarray, centers: np.ndarray | None) -> np.ndarray:
    """The nearest center of each profile, the lowest on ties; -1 without long words, -2 without any word. Without centers: the class of the largest bin modulo TOPICS."""
    if centers is None:
        near = profile.argmax(1) % TOPICS
    else:
        near = (profile.astype(np.int64) @ centers.T).argmax(1)
    return np.where(profile.any(1), near, np.where(tokens > 0, -1, -2)).astype(np.int32)


def learn_topics(slim: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Whole-numbered centers [TOPICS, BINS] from (tokens, profile) of all documents."""
    spark, centers = slim.sparkSession, None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centers)

        def run(batches, shared=shared):
            sums = np.zeros((TOPICS, BINS), np.int64)
            for b in batches:
                own = unpacked(b.column(1))
                near = topics_of(own, b.column(0).to_numpy(), shared.value)
                for k in range(TOPICS):
                    sums[k] += own[near == k].sum(0, dtype=np.int64)
            at = np.flatnonzero(sums.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["at", "n"])

        # TOPICS * BINS rows at most.
        sums = np.zeros(TOPICS * BINS)
        for r in slim.mapInArrow(tidy(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            sums[r["at"]] = r.n
        sums = sums.reshape(TOPICS, BINS)
        centers = np.rint(1e6 * sums / np.maximum(1.0, np.sqrt((sums * sums).sum(1, keepdims=True)))).astype(np.int64)
    return centers if centers is not None else np.zeros((TOPICS, BINS), np.int64)


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, BINS)


def with_profiles(docs: DataFrame, text: str, tokens: str, profile: str) -> DataFrame:
    """`docs` with token count and word profile of each text."""
    where = docs.columns.index(text)

    def add(batches):
        for b in batches:
            n, p = profiles(b.column(where))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array([x.tobytes() for x in p], pa.binary())], names=[*b.schema.names, tokens, profile])

    return docs.mapInArrow(tidy(add), extended(docs, **{tokens: LongType(), profile: BinaryType()}))


def with_topics(docs: DataFrame, centers: np.ndarray, tokens: str, profile: str, topic: str) -> DataFrame:
    """`docs` with the topic of each profile instead of the profile."""
    at, by, shared = docs.columns.index(profile), docs.columns.index(tokens), docs.sparkSession.sparkContext.broadcast(centers)
    rest = [c for c in docs.columns if c != profile]

    def add(batches):
        for b in batches:
            t = topics_of(unpacked(b.column(at)), b.column(by).to_numpy(), shared.value)
            yield pa.RecordBatch.from_arrays([*(x for k, x in enumerate(b.columns) if k != at), pa.array(t)], names=[*rest, topic])

    return docs.mapInArrow(tidy(add), extended(docs.select(*rest), **{topic: IntegerType()}))


def with_text_topics(docs: DataFrame, centers: np.ndarray, text: str, tokens: str, topic: str) -> DataFrame:
    """`docs` with token count and topic of each text, in one pass of one worker."""
    where, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(centers)

    def add(batches):
        for b in batches:
            n, p = profiles(b.column(where))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(topics_of(p, n, shared.value))], names=[*b.schema.names, tokens, topic])

    return docs.mapInArrow(tidy(add), extended(docs, **{tokens: LongType(), topic: IntegerType()}))


def rake(cells: list[tuple], targets: list[dict], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Fitted shares of cells (a, b, ..., total): each axis's marginal shares meet the targets.

    Targets of values without cells are spread over the axis's others.
    """
    total = np.array([c[-1] for c in cells], dtype=float)
    fitted = total / total.sum()
    axes = []
    for k, target in enumerate(targets):
        values = sorted({c[k] for c in cells}, key=repr)
        at = {v: i for i, v in enumerate(values)}
        want = np.array([max(0.0, float(target.get(v, 0.0))) for v in values])
        axes.append((np.array([at[c[k]] for c in cells]), want / want.sum()))
    for _ in range(rounds):
        off = 0.0
        for index, want in axes:
            have = np.bincount(index, fitted, minlength=len(want))
            off = max(off, float(np.abs(have - want).max()))
            fitted = fitted * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[index]
        if off < tolerance:
            break
    return fitted / fitted.sum()


def tempered(cells: list[tuple], k: int, power: float) -> dict:
    """Target shares of axis k proportional to its totals to `power`."""
    sums: dict = {}
    for c in cells:
        sums[c[k]] = sums.get(c[k], 0) + c[-1]
    raised = {v: float(s) ** power for v, s in sums.items()}
    whole = sum(raised.values())
    return {v: s / whole for v, s in raised.items()}


def calibrate(weights: np.ndarray, totals: np.ndarray, share: float) -> np.ndarray:
    """Probabilities min(1, c * weight), with c such that they keep `share` of the totals in expectation."""
    most = float(totals[weights > 0].sum())
    goal = min(share * float(totals.sum()), most)
    lo, hi = 0.0, 1.0
    while (np.minimum(1, hi * weights) * totals).sum() < goal * (1 - 1e-12) and hi < 1e30:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (np.minimum(1, mid * weights) * totals).sum() < goal else (lo, mid)
    return np.minimum(1, hi * weights)


def cell_plan(cells: list[tuple], share: float, powers: tuple[float, ...], targets: list[dict] | None = None, rounds: int = 200) -> list[tuple]:
    """(a, b, c, weight, probability) of every cell; cells without tokens have weight 1 and the probability `share`."""
    full = [c for c in cells if c[-1] > 0]
    out = [(*c[:-1], 1.0, float(share)) for c in cells if c[-1] <= 0]
    if full:
        wanted = targets or [tempered(full, k, p) for k, p in enumerate(powers)]
        totals = np.array([c[-1] for c in full], dtype=float)
        weights = rake(full, wanted, rounds) / (totals / totals.sum())
        out += [(*c[:-1], float(w), float(p)) for c, w, p in zip(full, weights, calibrate(weights, totals, share), strict=True)]
    return out


def spark_cell_plan(cells: DataFrame, share: float, powers: tuple[float, ...], targets: list[dict] | None = None, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """As cell_plan, for any number of cells (a, b, c, n): all sums are Spark's, and the driver sees single numbers."""
    axes, spark = cells.columns[:-1], cells.sparkSession
    kind = {f.name: f.dataType for f in cells.schema.fields}
    full = materialize(cells.where("n > 0"))
    empty = cells.where("not coalesce(n > 0, false)").select(*axes, F.lit(1.0).alias("weight"), F.lit(float(share)).alias("probability"))
    total = full.agg(F.sum("n").cast("double").alias("n")).first().n
    if not total:
        return empty
    wanted = []
    for k, axis in enumerate(axes):
        sums = full.groupBy(axis).agg(F.sum("n").cast("double").alias("s"))
        if targets:
            given = spark.createDataFrame([(v, float(x)) for v, x in targets[k].items()], StructType([StructField("v", kind[axis]), StructField("x", DoubleType())]))
            raw = sums.join(given, sums[axis].eqNullSafe(given["v"]), "left").select(axis, F.greatest(F.lit(0.0), F.coalesce("x", F.lit(0.0))).alias("raw"))
        else:
            raw = sums.select(axis, F.pow("s", F.lit(float(powers[k]))).alias("raw"))
        raw = materialize(raw)
        whole = raw.agg(F.sum("raw").alias("w")).first().w
        wanted.append(raw.select(F.col(axis).alias("v"), (F.col("raw") / whole).alias("want")))
    fitted = full.withColumn("f", F.col("n") / total)
    for _ in range(rounds):
        fitted = fitted.withColumn("off", F.lit(0.0))
        for axis, want in zip(axes, wanted, strict=True):
            have = fitted.groupBy(F.col(axis).alias("u")).agg(F.sum("f").alias("have"))
            both = have.join(want, F.col("u").eqNullSafe(F.col("v"))).select("u", "have", "want")
            scaled = F.when(F.col("have") > 0, F.col("f") * F.col("want") / F.col("have")).otherwise(0.0).alias("f")
            fitted = fitted.join(both, F.col(axis).eqNullSafe(F.col("u"))).select(*axes, "n", scaled, F.greatest("off", F.abs(F.col("have") - F.col("want"))).alias("off"))
        fitted = materialize(fitted)
        if fitted.agg(F.max("off").alias("off")).first().off < tolerance:
            break
    whole = fitted.agg(F.sum("f").alias("f")).first().f
    plan = materialize(fitted.select(*axes, "n", (F.col("f") / whole / (F.col("n") / total)).alias("weight")))
    kept = lambda at: plan.agg(*(F.sum(F.least(F.lit(1.0), c * F.col("weight")) * F.col("n")).alias(f"k{i}") for i, c in enumerate(at))).first()
    goal = min(share * total, plan.agg(F.sum(F.when(F.col("weight") > 0, F.col("n")).otherwise(0)).cast("double").alias("m")).first().m)
    lo, hi = 0.0, 1.0
    while kept([hi])[0] < goal * (1 - 1e-12) and hi < 1e30:
        hi *= 2
    for _ in range(10):
        at = [lo + (hi - lo) * i / 32 for i in range(33)]
        k = max(1, next((i for i, s in enumerate(kept(at)) if s >= goal), 32))
        lo, hi = at[k - 1], at[k]
    return plan.select(*axes, "weight", F.least(F.lit(1.0), hi * F.col("weight")).alias("probability")).unionByName(empty)


def mix(
    docs: DataFrame, share: float = 0.5, powers: tuple[float, float, float] = (0.5, 0.7, 0.5), targets: list[dict] | None = None, seed: int = 42,
    text: str = "text", id: str = "doc_id", source: str = "source", lang: str = "lang", topic: str | None = None, keep_text: bool = True, rounds: int = 200,
) -> DataFrame:
    """`docs` with mix_tokens, mix_topic, mix_weight, mix_probability and mix_kept.

    Target shares of sources, languages and topics: `targets` (three dicts), or
    the corpus's own token shares raised to `powers`; raking stops after
    `rounds` rounds, or when the marginals are met. The topic is the column
    `topic` where one is named, else the class that learn_topics finds. A
    document is kept if a hash of its id, text and the seed falls under its
    probability, so repeated rows share their fate and reruns agree. Null
    source, language or topic is a value of its own; null or empty texts have
    no tokens, weight 1 and probability `share`. An empty table gives an empty
    table. Input columns are passed on, whatever their names, but the text
    without `keep_text`; one with the name of a new column is replaced.
    """
    new = ["mix_tokens", "mix_topic", "mix_weight", "mix_probability", "mix_kept"]
    named = F.lit(None).cast("int") if topic is None else F.col(topic)
    lost, profile, u, own = unused(docs, "mix_lost", "mix_profile", "mix_u", "mix_own")
    docs = docs.withColumn(own, named).drop(*new)
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(id), F.xxhash64(F.coalesce(F.col(text), F.lit("")))), F.lit(1 << 40)) / float(1 << 40)
    docs = docs.withColumn(u, hashed)
    slim = with_profiles(docs if not keep_text else docs.select(*dict.fromkeys((source, lang, own, text))), text, "mix_tokens", profile)
    slim = materialize(slim.drop(text))
    centers = learn_topics(slim.select("mix_tokens", profile)) if topic is None else np.zeros((TOPICS, BINS), np.int64)
    classed = lambda df: with_topics(df, centers, "mix_tokens", profile, "mix_topic").drop(own) if topic is None else df.drop(profile).withColumnRenamed(own, "mix_topic")
    cells = classed(slim).groupBy(F.col(source).alias("a"), F.col(lang).alias("b"), F.col("mix_topic").alias("c")).agg(F.sum("mix_tokens").alias("n"))
    found = [tuple(r) for r in cells.limit(DRIVER_CELLS + 1).collect()]
    few, spark = len(found) <= DRIVER_CELLS, docs.sparkSession
    if few:
        schema = StructType([*cells.schema.fields[:3], StructField("weight", DoubleType()), StructField("probability", DoubleType())])
        plan = F.broadcast(spark.createDataFrame(cell_plan(found, share, powers, targets, rounds), schema))
    else:
        plan = spark_cell_plan(materialize(cells), share, powers, targets, rounds)
    plan = plan.select(F.struct("a", "b", "c", "weight", "probability").alias(lost))
    if keep_text and topic is None:
        every = with_text_topics(docs, centers, text, "mix_tokens", "mix_topic").drop(own)
    else:
        every = classed(with_profiles(docs, text, "mix_tokens", profile) if keep_text else slim)
    on = F.col(source).eqNullSafe(F.col(f"{lost}.a")) & F.col(lang).eqNullSafe(F.col(f"{lost}.b")) & F.col("mix_topic").eqNullSafe(F.col(f"{lost}.c"))
    out = every.join(plan, on).withColumns({"mix_weight": F.col(f"{lost}.weight"), "mix_probability": F.col(f"{lost}.probability")})
    return out.withColumn("mix_kept", F.col(u) < F.col("mix_probability")).drop(lost, u)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and fate of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, keep_text=False).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))
