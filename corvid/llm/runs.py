"""Periodic runs: maximal stretches of words that repeat themselves a number of times over.

Every lag up to a text's length / `times` is looked at: the array of word ids
is compared with itself shifted by the lag, and true stretches that are long
enough become runs. Texts of a batch lie end to end, longest first, and no two
share an id, so one comparison serves all texts that the lag concerns. A long
text's lags are cut into ranges of bounded work, which Spark deals out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corvid.llm.frames import extended, tidy, unused
from corvid.llm.textbytes import slices
from corvid.sources.tables import table

MIN_WORDS, TIMES = 24, 3
#: Word comparisons of one range of lags; a text that may need more is cut into ranges.
WORK = 1 << 30
#: Ranges that are dealt out to one task each, at most; more share tasks.
MOST_TASKS = 1 << 14

RUN = StructType([StructField(k, LongType()) for k in ("start", "length", "period")])
ARROW_RUN = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII blanks of a column of texts, and each text's offset in them (null: no words)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
    every, ends = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    full = np.asarray(pc.binary_length(every)) > 0
    return every.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


def word_ids(words: pa.Array, offsets: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The ids of the texts of `order`, end to end; equal words of a text have one id, texts share none."""
    out, base = [np.zeros(0, np.int32)], 0
    for k in order:
        coded = words.slice(offsets[k], offsets[k + 1] - offsets[k]).dictionary_encode()
        out.append(np.asarray(coded.indices, np.int32) + np.int32(base))
        base += len(coded.dictionary)
    return np.concatenate(out)


def repeats(ids: np.ndarray, sizes: np.ndarray, lo: int, hi: int, min_words: int, times: int) -> np.ndarray:
    """[k, (start, length, period)] of the runs with a period from `lo` to below `hi`.

    `sizes` are the lengths of the texts that lie end to end in `ids`, in
    descending order. Of runs with one extent the smallest period stays: a
    stretch that is a number of times as long as two periods has their greatest
    common divisor as a period too, and a run of that one has the same extent.
    """
    ends, out = np.cumsum(sizes), [np.zeros((0, 3), np.int64)]
    lags = np.arange(lo, max(lo, min(hi, int(sizes[0]) // times + 1 if len(sizes) else 0)))
    concerned = ends[np.searchsorted(-sizes, -times * lags, side="right") - 1] if len(lags) else lags
    same = np.empty(len(ids), bool)
    for lag, end in zip(lags.tolist(), concerned.tolist(), strict=True):
        eq = np.equal(ids[lag:end], ids[: end - lag], out=same[: end - lag])
        need = max(min_words - lag, (times - 1) * lag, 1)
        # A stretch of `need` covers this many marks in a row, whatever its start; most lags have no such place.
        step = max(1, need // 4)
        marks, hit = need // step, eq[::step]
        hit = hit[: max(0, len(hit) - marks + 1)].copy() if marks > 1 else hit
        for k in range(1, marks):
            hit &= eq[k * step :: step][: len(hit)]
        if not hit.any():
            continue
        gaps = np.concatenate([[-1], np.flatnonzero(~eq), [len(eq)]])
        trues = np.diff(gaps) - 1
        long = np.flatnonzero(trues >= need)
        out.append(np.stack([gaps[long] + 1, trues[long] + lag, np.full(len(long), lag)], 1))
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[first]


def runs_of(words: pa.Array, offsets: np.ndarray, min_words: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, run) of all runs of all texts, by text, start and period."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(min_words, times)]
    own = sizes[order]
    found = repeats(word_ids(words, offsets, order), own, 1, int(own[0]) // times + 1 if len(own) else 1, min_words, times)
    begins = np.cumsum(own) - own
    nth = np.searchsorted(begins, found[:, 0], side="right") - 1
    found[:, 0] -= begins[nth] if len(nth) else 0
    text = order[nth] if len(nth) else np.zeros(0, np.int64)
    by = np.lexsort((found[:, 2], found[:, 0], text))
    return text[by], found[by]


def without_repeats(words: pa.Array, offsets: np.ndarray, text: np.ndarray, found: np.ndarray) -> pa.Array:
    """Each text's words, joined by one blank, without those that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    at = offsets[:-1][text] + found[:, 0] if len(text) else np.zeros(0, np.int64)
    np.add.at(edge, at + found[:, 2], 1)
    np.add.at(edge, at + found[:, 1], -1)
    keep = np.cumsum(edge)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string())).cast(pa.string())


def run_lists(count: int, text: np.ndarray, found: np.ndarray) -> pa.Array:
    ends = np.searchsorted(text, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(3)], fields=list(ARROW_RUN)))


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """`docs` with the runs of each text and the text without its repeats.

    A run is a stretch of words with smallest period p, of min_words words and
    p times `times` words at least, that neither neighbouring word extends; `runs` has struct(start,
    length, period) by start, then period. `collapsed` has the words, joined by one
    blank, but those that some run holds after its first p words. Words are what
    lies between ASCII blanks. A null or empty text has no run and collapses to
    an empty one. Repeated rows have equal results. An empty table gives an empty
    one. Other columns pass unchanged; those named like the two new ones are replaced.

    Time grows with the square of a text's words, as all lags are compared; texts
    that may need more than WORK comparisons are cut into ranges of lags, each read
    with its whole text by one task, once for all equal texts. A task needs memory
    in proportion to one text.
    """
    docs = docs.drop(runs, collapsed)
    where, new = docs.columns.index(text), {runs: ArrayType(RUN), collapsed: StringType()}
    names = [*docs.columns, runs, collapsed]
    # A text of b bytes has (b + 1) / 2 words at most.
    most = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("double") / 2
    heavy = most * most / times > WORK

    def whole(batches):
        for b in batches:
            for lo, hi in slices(b.column(where)):
                part = b.slice(lo, hi - lo)
                words, offsets = split_words(part.column(where))
                at, found = runs_of(words, offsets, min_words, times)
                yield pa.RecordBatch.from_arrays([*part.columns, run_lists(hi - lo, at, found), without_repeats(words, offsets, at, found)], names=names)

    short = docs.where(~heavy).mapInArrow(tidy(whole), extended(docs, **new))
    key, lags, ranges = unused(docs, "run_key", "run_lags", "run_range")
    long = docs.where(heavy).withColumn(key, F.sha2(F.encode(text, "UTF-8"), 256))
    # Lags and ranges by the exact number of words.
    n = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("double")
    texts = long.select(key, text).dropDuplicates([key]).select(key, F.col(text).alias("t"), (F.floor(n / times) + 1).alias(lags), F.greatest(F.lit(1), F.least(F.floor(n / times), F.ceil(n * n / times / WORK))).cast("int").alias("r"))
    total = texts.agg(F.sum("r")).first()[0]
    if not total:
        return short
    pieces = texts.select(key, "t", lags, "r", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias(ranges)).repartition(min(MOST_TASKS, total), key, ranges)

    def ranged(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(j)[k] for j, c in enumerate((key, "t", lags, "r", ranges))}
                words, offsets = split_words(pa.array([row["t"].as_py()]))
                edge = lambda i: 1 + (row[lags].as_py() - 1) * i // row["r"].as_py()
                found = repeats(word_ids(words, offsets, np.zeros(1, np.int64)), np.diff(offsets), edge(row[ranges].as_py()), edge(row[ranges].as_py() + 1), min_words, times)
                yield pa.RecordBatch.from_arrays([pa.array([row[key].as_py()] * len(found), pa.string()), *(pa.array(np.ascontiguousarray(found[:, j])) for j in range(3))], names=[key, "start", "length", "period"])

    found = pieces.mapInArrow(tidy(ranged), f"`{key}` string, start long, length long, period long")
    found = found.groupBy(key, "start", "length").agg(F.min("period").alias("period"))
    # A text has fewer runs than words.
    lists = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("f")).select(key, F.transform("f", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias(runs))
    known = long.join(lists, key, "left").select(*docs.columns, F.coalesce(runs, F.array().cast(ArrayType(RUN))).alias(runs))

    def collapse(batches):
        for b in batches:
            for k in range(b.num_rows):
                part = b.slice(k, 1)
                words, offsets = split_words(part.column(where))
                own = part.column(len(names) - 2).flatten()
                found = np.stack([np.asarray(own.field(j), np.int64) for j in range(3)], 1)
                yield pa.RecordBatch.from_arrays([*part.columns, without_repeats(words, offsets, np.zeros(len(found), np.int64), found)], names=names)

    return short.unionByName(known.mapInArrow(tidy(collapse), extended(docs, **new)))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by crc32 of the id, repeats some of its words to its end.

    Of n words, each word i from a on becomes word a + (i - a) % p. Null ids
    and texts without words stay as they are.
    """

    def planted(id: int, text: str) -> str:
        share, rest = divmod(zlib.crc32(str(id).encode()), 10)
        words = text.encode().split() if rest == 0 else []
        if not words:
            return text
        a = share % len(words)
        p = 1 + (len(words) - a) // (3 + share % 8)
        return b" ".join(words[:a] + [words[a + i % p] for i in range(len(words) - a)]).decode()

    def run(batches):
        for b in batches:
            texts = [t if i is None or t is None else planted(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document with planted repeats: number, best exponent, and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # The greatest length / period, compared as whole numbers; the list is by start and period, so the first of equals stays.
    nearer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda best, r: F.when(nearer(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    b = F.col("best")
    return rows.select("doc_id", "n_runs", b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"), F.floor(b["length"] * 1000 / b["period"]).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
