"""Line quality by a linear-chain conditional random field.

Every line of a text is labelled good or bad from features of itself and of
its neighbours; forward-backward marginals, weighted by line length, give the
document's quality, which a logistic curve calibrates to the labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvid.llm.frames import extended
from corvid.llm.textbytes import flat, mix, slices, words

#: Labelled documents that the model is fitted on, the first by a hash of their id; their texts are read whole.
TRAIN_DOCS = 6_000
BINS = 8
#: Weights of the squares in the objective, per document.
PENALTY, LINK_PENALTY = 1e-2, 5e-2


def _classes() -> np.ndarray:
    c = np.zeros((6, 256), dtype=np.int64)
    c[0, 65:91] = c[0, 97:123] = c[0, 128:] = 1  # letters and bytes beyond ASCII
    c[1, 65:91] = 1  # capitals
    c[2, 48:58] = 1  # digits
    c[3, [33, 63]] = 1
    c[4, [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 124, 126, 123, 125, 91, 93, 47]] = 1
    c[5, [46, 44, 59, 58]] = 1
    return c


CLASSES = _classes()


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [line, feature], byte length of each line, number of lines of each row); an empty text is one empty line."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    per_row = np.bincount(owner, minlength=rows) + 1
    total = int(per_row.sum())
    begin, stop = np.zeros(total, np.int64), np.zeros(total, np.int64)
    first = np.cumsum(per_row) - per_row
    last = first + per_row - 1
    inner = np.ones(total, bool)
    inner[first] = False
    begin[first], begin[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[last] = False
    stop[last], stop[inner] = offsets[1:], breaks
    row = np.repeat(np.arange(rows), per_row)
    size = stop - begin
    some = np.maximum(1, size).astype(float)
    ratios = []
    for c in CLASSES:
        sums = np.concatenate([[0], np.cumsum(c[data])])
        ratios.append((sums[stop] - sums[begin]) / some)
    hashed, length, start, _ = words(data, offsets)
    line = np.searchsorted(begin, start, side="right") - 1
    n = np.bincount(line, minlength=total)
    many = np.maximum(1, n).astype(float)
    again = np.zeros(len(start), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
    key = hashed ^ mix(line.astype(np.uint64) + np.uint64(1))
    kinds = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=total)
    short = np.bincount(line, length <= 3, minlength=total) / many
    whole = np.zeros(total, np.uint64)
    np.add.at(whole, line, mix(hashed + start.astype(np.uint64) - begin[line].astype(np.uint64)))
    _, at, copies = np.unique(whole ^ mix(row.astype(np.uint64) + np.uint64(7)), return_inverse=True, return_counts=True)
    features = np.stack([
        *ratios, np.log1p(size), np.log1p(n), np.bincount(line, length, minlength=total) / many,
        np.bincount(line, again, minlength=total) / many, kinds / many, short, np.log(copies[at]),
    ], axis=1)
    return features, size, per_row


def binned(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], features[:, k], side="right") for k in range(features.shape[1])], axis=1)


def with_neighbours(bins: np.ndarray, per_row: np.ndarray, width: int) -> np.ndarray:
    """[line, feature] columns into the weights: own bins, the previous line's, the next one's; `width` stands for no line."""
    k = bins.shape[1]
    own = bins + np.arange(k) * BINS
    first = np.zeros(len(bins), bool)
    ends = np.cumsum(per_row)
    first[ends - per_row] = True
    final = np.zeros(len(bins), bool)
    final[ends - 1] = True
    before, after = np.roll(own, 1, axis=0) + k * BINS, np.roll(own, -1, axis=0) + 2 * k * BINS
    before[first], after[final] = width, width
    return np.concatenate([own, before, after], axis=1)


def marginals(evidence: np.ndarray, per_row: np.ndarray, link: np.ndarray, weight: np.ndarray | None = None):
    """P(good) of every line, and the expected pair counts [2, 2] of neighbouring labels, each row's times its weight.

    `evidence` is each line's log-odds, `link` the [2, 2] transition scores.
    Rows run in step, the longest first; ratios stay finite at any length.
    """
    a = np.exp(link - link.max())
    odds = np.exp(np.clip(evidence, -30, 30))
    order = np.argsort(-per_row, kind="stable")
    first = (np.cumsum(per_row) - per_row)[order]
    n = per_row[order]
    active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    fore, back = np.zeros(len(evidence)), np.full(len(evidence), 0.5)
    for t, m in enumerate(active):
        at = first[:m] + t
        x = fore[at - 1] if t else np.full(m, 0.5)
        good = odds[at] * ((x * a[1, 1] + (1 - x) * a[0, 1]) if t else 0.5)
        bad = (x * a[1, 0] + (1 - x) * a[0, 0]) if t else np.full(m, 0.5)
        fore[at] = good / (good + bad)
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        y = back[at + 1]
        g1, g0 = odds[at + 1] * y, 1 - y
        good, bad = a[1, 1] * g1 + a[1, 0] * g0, a[0, 1] * g1 + a[0, 0] * g0
        back[at] = good / (good + bad)
    up = fore * back
    p = up / (up + (1 - fore) * (1 - back))
    inner = np.ones(len(evidence), bool)
    inner[np.cumsum(per_row) - per_row] = False
    to = np.flatnonzero(inner)
    x, y, o = fore[to - 1], back[to], odds[to]
    pair = np.stack([(1 - x) * a[0, 0] * (1 - y), (1 - x) * a[0, 1] * o * y, x * a[1, 0] * (1 - y), x * a[1, 1] * o * y])
    pair = pair / np.maximum(pair.sum(axis=0), 1e-300)
    if weight is not None:
        pair = pair * np.repeat(weight, per_row)[to]
    return p, pair.sum(axis=1).reshape(2, 2)


def weigh(p: np.ndarray, size: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Length-weighted mean of each row's line marginals, as log-odds."""
    row = np.repeat(np.arange(len(per_row)), per_row)
    w = size + 1.0
    share = np.bincount(row, p * w, minlength=len(per_row)) / np.maximum(np.bincount(row, w, minlength=len(per_row)), 1e-300)
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def train(features: np.ndarray, size: np.ndarray, per_row: np.ndarray, labels: np.ndarray, rounds: int = 150) -> dict:
    """Weights, transitions and calibration.

    A line's label is its document's, as no line labels exist. What is raised is one
    penalised sum: over documents, the log-probability of the label chain per line, with
    both labels in balance, less the squares of the weights and of the transitions. As a
    chain never changes its label here, only the penalty bounds the transitions.
    """
    edges = np.quantile(features, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    width = 3 * features.shape[1] * BINS
    columns = with_neighbours(binned(features, edges), per_row, width)
    y = np.repeat(labels, per_row).astype(float)
    share = np.array([max(1, (labels == k).sum()) for k in (0, 1)], dtype=float)
    weight = len(labels) / (2 * share[labels]) / per_row
    line_weight = np.repeat(weight, per_row)
    w, link = np.zeros(width + 1), np.zeros((2, 2))
    past, past_link, rate = np.full(width + 1, 1e-6), np.full((2, 2), 1e-6), 0.3
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per_row) - per_row] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), line_weight[inner])
    for _ in range(rounds):
        p, pairs = marginals(w[columns].sum(axis=1), per_row, link, weight)
        miss = (y - p) * line_weight
        gradient = np.bincount(columns.ravel(), np.repeat(miss, columns.shape[1]), minlength=width + 1) - PENALTY * len(labels) / width * w
        gradient[width] = 0
        past += gradient**2
        w += rate * gradient / np.sqrt(past)
        gradient = seen - pairs - LINK_PENALTY * len(labels) * link
        past_link += gradient**2
        link = link + rate * gradient / np.sqrt(past_link)
    p, _ = marginals(w[columns].sum(axis=1), per_row, link)
    z = weigh(p, size, per_row)
    a, b = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = q * (1 - q) + 1e-6
        g = np.array([((labels - q) * z).sum() - 1e-3 * a, (labels - q).sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum()]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return {"edges": edges, "w": w, "link": link, "a": float(a), "b": float(b)}


def score_column(model: dict | None, column: pa.Array) -> np.ndarray:
    out = []
    for lo, hi in slices(column):
        if model is None:
            out.append(np.full(hi - lo, 0.5))
            continue
        features, size, per_row = line_features(*flat(column.slice(lo, hi - lo)))
        columns = with_neighbours(binned(features, model["edges"]), per_row, len(model["w"]) - 1)
        p, _ = marginals(model["w"][columns].sum(axis=1), per_row, model["link"])
        out.append(1 / (1 + np.exp(-np.clip(model["a"] * weigh(p, size, per_row) + model["b"], -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", sample: int = TRAIN_DOCS) -> dict | None:
    """The model from at most `sample` rows of `labels` (label 0 or 1) and their documents; None if a label is missing.

    Half of the sample may come from either label, so that a rare one is seen;
    within a label the first by a hash of the id are taken. Features of whole
    texts are made on the executors; the driver gets those.
    """

    def run(batches):
        for b in batches:
            parts = []
            for k in range(b.num_rows):
                f, size, _ = line_features(*flat(b.column(0).slice(k, 1)))
                parts.append((f.astype(np.float32).tobytes(), size.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2).cast(pa.int64()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["y", "i", "f", "s"])

    own = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("i"), F.col(label).cast("int").alias("y"))
    total = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return None
    order = (F.xxhash64("i"), "i")
    picked = own.where("y = 0").orderBy(*order).limit(sample // 2).unionByName(own.where("y = 1").orderBy(*order).limit(sample // 2))
    # `picked` has at most `sample` rows.
    texts = docs.where(F.col(text).isNotNull()).join(F.broadcast(picked), F.col(id) == F.col("i")).select(F.col(text).alias("t"), "y", "i")
    rows = texts.select("t", "y", "i").mapInArrow(run, "y int, i long, f binary, s binary").orderBy("i", "y", "f").collect()
    if len({r.y for r in rows}) < 2:
        return None
    sizes = [np.frombuffer(r.s, np.int64) for r in rows]
    features = np.concatenate([np.frombuffer(r.f, np.float32).reshape(len(s), -1) for r, s in zip(rows, sizes, strict=True)]).astype(float)
    labels = np.array([r.y for r in rows])
    model = train(features, np.concatenate(sizes), np.array([len(s) for s in sizes]), labels)
    # Back from the sample's odds to those of all labelled documents.
    taken = np.bincount(labels, minlength=2)
    model["b"] += float(np.log(total[1] / total[0]) - np.log(taken[1] / taken[0]))
    return model


def score(docs: DataFrame, model: dict | None, text: str = "text", column: str = "quality_score") -> DataFrame:
    """`docs` with the probability that the quality label is 1.

    Null counts as empty; an empty text is one empty line. Without a model
    (no labels of both kinds) every score is 0.5. Rows and other columns pass
    unchanged; an input column of the new name is replaced. An empty table
    gives an empty table.
    """
    docs = docs.drop(column)
    where, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_column(shared.value, b.column(where)), pa.float64())], names=[*b.schema.names, column])

    return docs.mapInArrow(run, extended(docs, **{column: DoubleType()}))


def held_out(id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; documents of the held-out fold are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out())
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
