"""Vector code compression: product codes of whole-number vectors, assigned by partial distances.

A vector is cut into equal parts, and each part is coded by its nearest entry of
that part's codebook. The search takes a part's components in descending
variance over the codebook and adds up squared differences; an entry is dropped
as soon as its sum exceeds the best complete distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corvid.llm.frames import tidy, unused
from corvid.sources.tables import table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole-number components beyond this have distances that a long can't hold.
LARGEST = 1 << 26
#: Vectors that are looked up at once.
SLICE = 1 << 12
#: Distinct labels that are sent to every executor, at most; more are joined by a shuffle.
FEW_LABELS = 1 << 14


def nearest_entry(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's nearest entry of `book`, ties to the first; both of whole numbers.

    The first component's nearest entry gives the first complete distance.
    Masks then drop, component by component, each pair of row and entry whose sum is
    strictly beyond its row's best, so equal entries stay.
    """
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    part = (rows[:, order[0], None] - book[None, :, order[0]]) ** 2
    best = ((rows - book[part.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(part <= best[:, None])
    part = part[row, entry]
    for at in order[1:]:
        part = part + (rows[row, at] - book[entry, at]) ** 2
        stay = part <= best[row]
        row, entry, part = row[stay], entry[stay], part[stay]
    least = np.minimum.reduceat(part, np.searchsorted(row, np.arange(len(rows)))) if len(rows) else part
    row, entry = row[hit := part == least[row]], entry[hit]
    return entry[np.searchsorted(row, np.arange(len(rows)))], least


def codes(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([row, part] entries, [row] summed distances) of vectors under books [part, entry, position]."""
    entries, error = np.empty((len(vectors), len(books)), np.int64), np.zeros(len(vectors), np.int64)
    for k, book in enumerate(books):
        width = book.shape[1]
        if not width:
            entries[:, k] = 0
            continue
        entries[:, k], distance = nearest_entry(vectors[:, k * width : (k + 1) * width], book)
        error += distance
    return entries, error


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(np.asarray(column.flatten(), np.float64) * SCALE).astype(np.int64).reshape(len(column), width)


def kept(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """The rows whose vector is there and all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col(vector).isNotNull() & F.forall(vector, finite)).withColumn(vector, F.col(vector).cast("array<double>"))


def fit(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, position], from rows that `kept` has passed.

    They start as the parts of the rows of the smallest ids (then of the smaller
    vectors; null ids last), all rows if there are fewer than `entries`. Every round
    assigns all rows and replaces each entry by the floor of its rows' mean; an
    entry without rows stays. Tasks add up their rows, and the driver gets one
    sum for each component of each entry.
    """
    sizes = rows.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.max(F.array_max(F.transform(vector, F.abs))).alias("far")).first()
    if sizes.lo is None:
        return np.zeros((parts, 0, 0), np.int64)
    if sizes.lo != sizes.hi or sizes.lo % parts:
        raise ValueError(f"vectors have {sizes.lo} to {sizes.hi} components; all need the same number, a multiple of {parts}")
    if (sizes.far or 0) * SCALE > LARGEST:
        raise ValueError(f"a component of {sizes.far} is beyond {LARGEST // SCALE}")
    width = sizes.lo // parts
    first = rows.select(id, vector).orderBy(F.asc_nulls_last(id), vector).limit(entries).collect()
    books = np.floor(np.array([r[vector] for r in first]) * SCALE).astype(np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if not width:
        return books
    for _ in range(rounds):
        sums = {r.cell: int(r.total) for r in rows.select(vector).mapInArrow(tidy(summed(books)), "cell int, total long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        cells = books.shape[0] * books.shape[1]
        for cell in range(cells):
            n = sums.get(cells * width + cell, 0)
            if n:
                books[cell // books.shape[1], cell % books.shape[1]] = [sums.get(cell * width + k, 0) // n for k in range(width)]
    return books


def summed(books: np.ndarray):
    """A function on batches of vectors that returns, for each component of each entry, the sum over its rows, and for each entry their number."""
    parts, entries, width = books.shape

    def run(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                vectors = whole_numbers(b.column(0).slice(lo, SLICE), parts * width)
                found, _ = codes(vectors, books)
                for k in range(parts):
                    np.add.at(total[k], found[:, k], vectors[:, k * width : (k + 1) * width])
                    count[k] += np.bincount(found[:, k], minlength=entries)
        every = np.concatenate([total.ravel(), count.ravel()])
        cell = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(every[cell])], names=["cell", "total"])

    return run


def encode(rows: DataFrame, books: np.ndarray, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """`rows` (that `kept` has passed) without their vectors, with each one's code (two hex digits a part) and summed squared distance."""
    rows = rows.drop(code, error)
    where, others = rows.columns.index(vector), [c for c in rows.columns if c != vector]
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != vector] + [StructField(code, StringType()), StructField(error, LongType())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                found, distance = codes(whole_numbers(part.column(where), books.shape[0] * books.shape[2]), books)
                text = [r.tobytes().hex() for r in found.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != where), pa.array(text, pa.string()), pa.array(distance)], names=[*others, code, error])

    return rows.mapInArrow(tidy(run), schema)


def compress(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a whole vector.

    Vectors that are null or hold a null or non-finite component are left out.
    All others must have one length, a multiple of the number of parts, and no
    component beyond 2^18: anything else is an error, as a long could not hold the
    distances. label_error sums the errors of equal labels, nulls together. Repeated
    rows are coded and counted each; a null id starts no entry. An empty table gives
    an empty one. Other columns are not read, whatever their names.
    """
    whole = kept(rows.select(F.col(id), F.col(vector), F.col(label)), id, vector)
    books = fit(whole, id, vector)
    coded = encode(whole, books, vector, *unused(whole, "code", "error"))
    code, error = coded.columns[-2:]
    name = F.struct(F.col(label).alias("l"))  # equal for two nulls, as a plain key is not
    sums = coded.groupBy(name.alias("key")).agg(F.sum(error).alias("label_error"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.withColumn("key", name).join(sums, "key").select(F.col(id), F.col(code).alias("code"), F.col(error).alias("error"), "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and errors of every embedding."""
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = "SELECT k, p, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(r.s, b.s)])::BIGINT * 64 + b.e) AS best FROM parts r JOIN {books} b USING (p) GROUP BY k, p"
    step = """SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM {old} b LEFT JOIN (
          SELECT p, e, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY j) AS s FROM (
            SELECT p, best % 64 AS e, j, sum(s[j])::BIGINT AS total, count(*) AS n FROM {near} JOIN parts USING (k, p), range(1, 1 + (SELECT max(len(s)) FROM parts)) t(j) GROUP BY ALL) GROUP BY p, e) m USING (p, e)"""
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, [floor(x::DOUBLE * 256)::BIGINT for x in embedding] AS v, len(embedding) // 16 AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        parts AS (SELECT k, p, v[p * w + 1 : (p + 1) * w] AS s FROM v, range(16) t(p)),
        b0 AS (SELECT p, k - 1 AS e, s FROM parts WHERE k <= 64),
        n0 AS ({near.format(books="b0")}), b1 AS ({step.format(old="b0", near="n0")}),
        n1 AS ({near.format(books="b1")}), b2 AS ({step.format(old="b1", near="n1")}),
        n2 AS ({near.format(books="b2")}),
        c AS (SELECT k, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM n2 GROUP BY k),
        h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (k), h"""


SQL = {"op13_vector_codes": _sql()}
