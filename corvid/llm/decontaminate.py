"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item is cut into windows of WINDOW bytes, one every STRIDE bytes
(shorter items are one window), so that any excerpt of WINDOW + STRIDE - 1
bytes holds a whole window. If a window of w bytes occurs in a text with at
most k edits, the two share at least w + 1 - (k + 1) * q q-grams, and those lie
on diagonals that are at most k apart. Shared q-grams are therefore counted in
bands of 2 * BAND diagonals that overlap by half; regions that meet the bound
are verified by an alignment within the band. Equal windows are one window of
several items. An item of fewer than q bytes has no q-gram and an edit budget
of 0: it is looked up wherever it stands as whole words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corvid.llm.frames import extended, tidy, unused
from corvid.llm.textbytes import IS_SPACE, LOWER, flat, slices

Q = 10
WINDOW = 120
STRIDE = 30
BAND = 16
ERROR = 0.08
MAP_BITS = 21
#: Benchmark characters that one index holds, about; a larger benchmark is searched in blocks, each one more pass over the texts.
BLOCK_BYTES = 4 << 20
#: Pairs of a text's and a window's q-gram that are held at once.
PAIRS = 1 << 18
#: Bytes of letters and digits, those beyond ASCII included.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
ONE = np.int64(1 << 20)
FAR = np.int64(1 << 40)


def normalize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, place of each byte in `data`): lower case of ASCII and Latin-1 letters, runs of blanks as one, none in front."""
    blank = IS_SPACE[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = ~blank[first]
    place = np.flatnonzero(keep)
    low = np.where(blank[place], np.uint8(32), LOWER[data[place]])
    # The capitals U+00C0 to U+00DE but for U+00D7 lie 32 below their small letters in the second byte.
    capital = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)
    low[1:][capital] += np.uint8(32)
    return low, np.searchsorted(place, offsets), place


def codes(b: np.ndarray) -> np.ndarray:
    """64-bit code of the q-gram that begins at each byte."""
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    return eight[:-2] * np.uint64(0x9E3779B97F4A7C15) + two[8:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def build_index(items: list[tuple[int, str]]) -> dict:
    """Distinct windows of all items, with their items, and the inverted list of their q-grams; and the items without one."""
    owners: dict[bytes, list[int]] = {}
    short: dict[bytes, list[int]] = {}
    for item, text in items:
        b, _, _ = normalize(*flat(pa.array([text or ""])))
        raw = b.tobytes().rstrip(b" ")
        starts = [0] if len(raw) <= WINDOW else [*range(0, len(raw) - WINDOW, STRIDE), len(raw) - WINDOW]
        for s in starts if raw else []:
            own = (owners if len(raw) >= Q else short).setdefault(raw[s : s + WINDOW], [])
            if not own or own[-1] != item:
                own.append(item)
    window = [np.frombuffer(w, np.uint8) for w in owners]
    size = np.array([len(w) for w in window], np.int64)
    budget = np.minimum((ERROR * size).astype(np.int64), size // Q - 1)
    grams = np.concatenate([codes(w) for w in window]) if window else np.zeros(0, np.uint64)
    counts = np.maximum(0, size - Q + 1)
    of = np.repeat(np.arange(len(window), dtype=np.int32), counts)
    pos = (np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint8)
    order = np.argsort(grams, kind="stable")
    unique, first = np.unique(grams[order], return_index=True)
    seen = np.zeros(1 << MAP_BITS, dtype=bool)
    seen[(unique >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True
    padded = np.zeros((len(window), WINDOW), np.uint8)
    for k, w in enumerate(window):
        padded[k, : len(w)] = w
    return {
        "owners": list(owners.values()), "size": size, "budget": budget, "bound": size + 1 - (budget + 1) * Q,
        "grams": unique, "ptr": np.append(first, len(grams)).astype(np.int32), "of": of[order], "pos": pos[order],
        "seen": seen, "windows": padded, "short": short,
    }


def whole_words(index: dict, b: np.ndarray, ends: np.ndarray):
    """(row, item, start, stop) of every short item where no letter or digit adjoins one of its own, the first spot in each row."""
    letter = WORD[b]
    for n in sorted({len(w) for w in index["short"]}):
        if len(b) < n:
            break
        grams = np.lib.stride_tricks.sliding_window_view(b, n)
        for w, items in index["short"].items():
            if len(w) != n:
                continue
            own = np.frombuffer(w, np.uint8)
            at = np.flatnonzero(b[: len(b) - n + 1] == own[0])
            at = at[(grams[at] == own).all(axis=1)]
            row = np.searchsorted(ends, at, side="right") - 1
            ok = at + n <= ends[row + 1]
            if WORD[own[0]]:
                ok &= (at == ends[row]) | ~letter[np.maximum(at - 1, 0)]
            if WORD[own[-1]]:
                ok &= (at + n == ends[row + 1]) | ~letter[np.minimum(at + n, len(b) - 1)]
            row, k = np.unique(row[ok], return_index=True)
            for r, start in zip(row.tolist(), (at[ok][k] - ends[row]).tolist(), strict=True):
                for item in items:
                    yield r, item, start, start + n


def align(index: dict, b: np.ndarray, begin: np.ndarray, end: np.ndarray, win: np.ndarray, low: np.ndarray):
    """(edits, start, stop) of the best occurrence of each window on the diagonals from `low`, in bytes of the text begin..end.

    The matrix row of a window byte spans the band's diagonals; a cell holds
    the edits and, in its low bits, the diagonal where the alignment began.
    """
    width = 2 * BAND + 2 * int(index["budget"].max()) + 1
    low = low - int(index["budget"].max())
    t = np.arange(width)
    ramp = t * ONE
    cell = np.repeat(t[None, :].astype(np.int64), len(win), axis=0)
    sizes, windows = index["size"][win], index["windows"][win]
    best = np.full(len(win), FAR)
    stop = np.zeros(len(win), np.int64)
    for i in range(1, int(sizes.max()) + 1):
        at = (low + i - 1)[:, None] + t
        inside = (at >= 0) & (at < (end - begin)[:, None])
        ch = b[np.clip(begin[:, None] + at, 0, len(b) - 1)]
        miss = np.where(inside & (ch == windows[:, i - 1][:, None]), np.int64(0), ONE)
        skip = np.full_like(cell, FAR)
        skip[:, :-1] = cell[:, 1:] + ONE
        cell = np.minimum(cell + miss, skip)
        cell = np.minimum.accumulate(cell - ramp, axis=1) + ramp
        done = sizes == i
        if done.any():
            k = cell[done].argmin(axis=1)
            best[done] = cell[done, k]
            stop[done] = low[done] + i + k
    return best >> 20, low + (best & (ONE - 1)), stop


def search(index: dict, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, stop) for each row and item found in it: the best occurrence, first on ties; code points, stop exclusive."""
    found = []
    for lo, hi in slices(column):
        data, offsets = flat(column.slice(lo, hi - lo))
        b, ends, place = normalize(data, offsets)
        hits: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, item, start, stop in whole_words(index, b, ends):
            hits[r, item] = (0, start, stop)
        code = codes(b)
        at = np.flatnonzero(index["seen"][(code >> np.uint64(64 - MAP_BITS)).astype(np.int64)]) if len(index["grams"]) else np.zeros(0, np.int64)
        if len(at):
            g = np.minimum(np.searchsorted(index["grams"], code[at]), len(index["grams"]) - 1)
            true = index["grams"][g] == code[at]
            at, g = at[true], g[true]
            row = np.searchsorted(ends, at, side="right") - 1
            whole = at + Q <= ends[row + 1]
            enough = np.bincount(row[whole], minlength=hi - lo)[row] >= index["bound"].min()
            at, g, row = at[whole & enough], g[whole & enough], row[whole & enough]
            for r, w, low in regions(index, at - ends[row], g, row, np.diff(ends)):
                edits, start, stop = align(index, b, ends[r], ends[r + 1], w, low)
                for k in np.flatnonzero(edits <= index["budget"][w]):
                    new = (int(edits[k]), max(0, int(start[k])), int(stop[k]))
                    for item in index["owners"][w[k]]:
                        it = (int(r[k]), item)
                        if it not in hits or new < hits[it]:
                            hits[it] = new
        for (r, item), (edits, start, stop) in sorted(hits.items()):
            spots = []
            for x in (start, stop - 1):
                x = place[min(ends[r] + x, ends[r + 1] - 1)]
                spots.append(int(((data[offsets[r] : x + 1] & 0xC0) != 0x80).sum()))
            found.append((lo + r, item, edits, spots[0] - 1, spots[1]))
    return found


def regions(index: dict, at: np.ndarray, g: np.ndarray, row: np.ndarray, length: np.ndarray):
    """Batches of (row, window, first diagonal) of bands that share as many q-grams as the lemma asks for. Rows, and places in them, ascend.

    Places go in runs of about PAIRS pairs. A run yields the bands that begin in its
    own stretch of the text, and reads on to where the last of these ends.
    """
    n = (index["ptr"][g + 1] - index["ptr"][g]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    windows, lo, reach = len(index["size"]), 0, 2 * BAND + WINDOW
    # Rows on one axis, further apart than a band reaches, each from a multiple of BAND.
    span = (length + 4 * reach) // BAND * BAND
    base = np.cumsum(span) - span + 2 * reach // BAND * BAND
    place, least = base[row] + at, -reach
    while lo < len(at):
        cut = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
        most = int(place[cut]) // BAND * BAND - WINDOW if cut < len(at) else 1 << 62
        if most <= least:
            most = least + BAND
        hi = int(np.searchsorted(place, most + reach))
        m = n[lo:hi]
        entry = np.repeat(index["ptr"][g[lo:hi]].astype(np.int64), m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        band = (np.repeat(place[lo:hi], m) - index["pos"][entry]) // BAND
        key = np.concatenate([band, band - 1])
        own = np.tile(index["of"][entry], 2)
        ok = (key * BAND >= least) & (key * BAND < most)
        key, count = np.unique(key[ok] * windows + own[ok], return_counts=True)
        w = key % windows
        ok = count >= index["bound"][w]
        start, w = key[ok] // windows * BAND, w[ok]
        r = np.searchsorted(base, start + reach, side="right") - 1
        for k in range(0, len(start), 4096):
            yield r[k : k + 4096], w[k : k + 4096], start[k : k + 4096] - base[r[k : k + 4096]]
        least = most
        lo = int(np.searchsorted(place, least))


def blocks(benchmark: DataFrame, item: str, text: str):
    """The benchmark in lists of (item, text) of at most about BLOCK_BYTES each."""
    rows, size = [], 0
    for r in benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        rows.append((r.i, r.t))
        size += len(r.t)
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    yield rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, stop): benchmark items of which a window occurs in a document within the edit budget.

    One row per document row and item, with its best occurrence in code points
    of the original text. An item of fewer than Q bytes (lower-cased, runs of blanks
    as one) is found where it stands as whole words; of equal items each is
    reported. Null or blank items and texts match nothing. Repeated rows are
    judged one by one. An empty table on either side gives an empty result.
    Other columns are not read, whatever their names. A text needs memory in
    proportion to its own length.
    """
    slim, spark, out = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), docs.sparkSession, None
    for items in blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(build_index(items))

        def run(batches, shared=shared):
            for b in batches:
                hits = search(shared.value, b.column(1))
                cols = list(zip(*hits, strict=True)) if hits else [[]] * 5
                ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["doc_id", "item_id", "edits", "start", "stop"])

        part = slim.mapInArrow(tidy(run), "doc_id long, item_id long, edits int, start long, stop long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` in which no benchmark item occurs, unchanged; nothing is shuffled.

    Nulls, empty tables, repeated rows: as in find_contamination. Other columns
    may have any names.
    """
    where, spark, mark = docs.columns.index(text), docs.sparkSession, unused(docs, "contaminated")[0]
    for items in blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(build_index(items))

        def run(batches, shared=shared):
            for b in batches:
                bad = np.zeros(b.num_rows, bool)
                bad[[h[0] for h in search(shared.value, b.column(where))]] = True
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bad)], names=[*b.schema.names, mark])

        docs = docs.mapInArrow(tidy(run), extended(docs, **{mark: BooleanType()})).where(~F.col(mark)).drop(mark)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in `documents`."""
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
