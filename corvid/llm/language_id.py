"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds the labelled text of a bounded number of
documents. A text is parsed greedily, from its beginning to its end, into the
longest phrases that occur in that text; the language that needs the fewest
phrases, normalised by the text's length, wins.

Long texts are parsed in parts side by side without a change of the result: a
part is parsed from its first byte, and then again from where the phrase that
reaches into it ends, until no part's beginning moves any more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from corvid.llm.frames import extended, tidy
from corvid.llm.textbytes import LOWER, flat, slices
from corvid.sources.tables import materialize

#: Distinct labelled texts that each language is learned from, at most; they are read whole.
TRAIN_DOCS = 64
#: Bytes of text that a language is learned from, and all languages together, at most.
TRAIN_BYTES, MODEL_BYTES = 1 << 18, 1 << 20
#: Languages whose counts are sent to every executor, at most; more are joined by a shuffle.
FEW_LANGUAGES = 1 << 14
#: Bytes of a text that one lane of the parser begins with.
PART = 2048
#: Bytes of text that are parsed at once.
SLICE = 1 << 21
WORD = 64
UNDETERMINED = "und"

LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[128:] = True
ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[97:123] = True
ASCII_LETTER[65:91] = True


def normalize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case (ASCII; other bytes as they are), each run of anything else as one blank."""
    low = LOWER[data]
    letter = LETTER[low]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = letter[first]
    low = np.where(letter, low, np.uint8(32))[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return low, kept[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `text`; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def transitions(text: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(number of states, state, symbol, target) of the automaton of `text`, by state and symbol; its last state has no way on."""
    moves = [*suffix_automaton(text), {}]
    state = np.repeat(np.arange(len(moves), dtype=np.int32), [len(m) for m in moves])
    symbol = np.fromiter((c for m in moves for c in m), np.uint8, len(state))
    to = np.fromiter((t for m in moves for t in m.values()), np.int32, len(state))
    order = np.lexsort((symbol, state))
    return len(moves), state[order], symbol[order], to[order]


def compile_automata(texts: dict[str, bytes]) -> dict:
    return assemble({name: transitions(t) for name, t in texts.items()})


def assemble(parts: dict[str, tuple]) -> dict:
    """All languages' automata in arrays: per state and 64 symbols a bit mask of the transitions and where they begin in `to`.

    `first` [language, symbol] is the state after a phrase's first symbol; a
    symbol that the language lacks leads to its last state, which has no way on.
    """
    languages = sorted(parts)
    used = np.unique(np.concatenate([np.zeros(0, np.uint8), *(symbol for _, _, symbol, _ in parts.values())]))
    alphabet = np.zeros(256, dtype=np.uint8)
    alphabet[used] = np.arange(1, len(used) + 1)
    width = -(-(len(used) + 1) // WORD)
    masks, targets, first, base = [], [], [], 0
    for name in languages:
        states, state, symbol, to = parts[name]
        # Symbols keep their order, so transitions are by state and new symbol already.
        symbol, to = alphabet[symbol].astype(np.int64), to + np.int32(base)
        mask = np.zeros(states * width, np.uint64)
        np.bitwise_or.at(mask, state.astype(np.int64) * width + symbol // WORD, np.uint64(1) << (symbol % WORD).astype(np.uint64))
        own = np.full(len(used) + 1, base + states - 1)
        own[symbol[state == 0]] = to[state == 0]
        masks.append(mask)
        targets.append(to)
        first.append(own)
        base += states
    mask = np.concatenate(masks) if masks else np.zeros(0, np.uint64)
    size = np.bitwise_count(mask).astype(np.int64)
    to = np.concatenate(targets) if targets else np.zeros(0, np.int32)
    return {"languages": languages, "alphabet": alphabet, "width": width, "mask": mask, "begin": (np.cumsum(size) - size).astype(np.int32), "to": np.append(to, 0).astype(np.int32), "first": np.array(first, np.int32).reshape(len(languages), len(used) + 1)}


def run_lanes(model: dict, symbols: np.ndarray, lang: np.ndarray, at: np.ndarray, stop: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, exit) of lanes that parse from `at`: phrases that begin before `stop`, and where the last of them ends, at `end` at most. All lanes begin before their `stop`."""
    count, exit, lane = np.ones(len(at), np.int64), end.copy(), np.arange(len(at))
    first, mask, begin, to, width = model["first"].ravel(), model["mask"], model["begin"], model["to"], model["width"]
    row = lang * model["first"].shape[1]
    state = first[row + symbols[at]]
    at, live = at + 1, np.ones(len(at), bool)
    while True:
        live &= at < end
        if not live.all():
            keep = np.flatnonzero(live)
            lane, row, at, stop, end, state = lane[keep], row[keep], at[keep], stop[keep], end[keep], state[keep]
            live = np.ones(len(keep), bool)
        if not len(lane):
            return count, exit
        c = symbols[at].astype(np.int64)
        cell = state if width == 1 else state * width + (c >> 6)
        own, bit = mask[cell], np.uint64(1) << (c & 63).astype(np.uint64)
        on = (own & bit) != 0
        state = to[begin[cell] + np.bitwise_count(own & (bit - np.uint64(1)))]
        off = np.flatnonzero(~on)
        if len(off):
            # A phrase ends here; the next one begins with this symbol, in this lane or in the part after it.
            state[off] = first[row[off] + c[off]]
            out = at[off] >= stop[off]
            count[lane[off[~out]]] += 1
            exit[lane[off[out]]] = at[off[out]]
            live[off[out]] = False
        at = at + 1


def phrases(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[row, language] number of phrases of the greedy parse of each whole normalised text."""
    rows, langs = len(offsets) - 1, len(model["languages"])
    length = np.diff(offsets)
    parts = -(-length // PART)
    row = np.tile(np.repeat(np.arange(rows), parts), langs)
    n = len(row) // max(1, langs)
    nth = np.tile(np.arange(n) - np.repeat(np.cumsum(parts) - parts, parts), langs)
    lang = np.repeat(np.arange(langs), n)
    start = offsets[:-1][row] + nth * PART
    end = offsets[1:][row]
    stop = np.minimum(start + PART, end)
    last = nth == parts[row] - 1
    symbols = model["alphabet"][data]
    at, count, exit = start.copy(), np.zeros(len(row), np.int64), start.copy()
    todo = np.arange(len(row))
    while len(todo):
        inside = at[todo] < stop[todo]
        passed = todo[~inside]
        count[passed], exit[passed] = 0, at[passed]
        mine = todo[inside]
        mine = mine[np.argsort(start[mine] - end[mine], kind="stable")]
        count[mine], exit[mine] = run_lanes(model, symbols, lang[mine], at[mine], stop[mine], end[mine])
        after = todo[~last[todo]]
        # A part begins anew where the one before it was left, if that has changed.
        moved = after[at[after + 1] != exit[after]]
        at[moved + 1] = exit[moved]
        todo = moved + 1
    out = np.zeros((rows, langs))
    np.add.at(out, (row, lang), count)
    return out


def predict(model: dict, column: pa.Array) -> tuple[list, np.ndarray]:
    """(language, score) of every text of a column."""
    langs, scores = [], []
    for lo, hi in slices(column, SLICE):
        data, offsets = flat(part := column.slice(lo, hi - lo))
        has = np.zeros(hi - lo, bool)
        full = np.diff(offsets) > 0
        if full.any():
            has[full] = np.maximum.reduceat(ASCII_LETTER[data].astype(np.uint8), offsets[:-1][full]) > 0
        for k in np.flatnonzero(full & ~has):
            has[k] = any(c.isalpha() for c in part[int(k)].as_py())
        low, ends = normalize(data, offsets)
        size = np.maximum(1, np.diff(ends))
        if model["languages"]:
            rate = np.maximum(1, phrases(model, low, ends)) / size[:, None]
            best = rate.argmin(1)
            odds = np.exp(-100.0 * (rate - rate.min(1, keepdims=True)))
            score = odds[np.arange(hi - lo), best] / odds.sum(1)
        else:
            best, score = np.zeros(hi - lo, int), np.zeros(hi - lo)
        sure = has & bool(model["languages"])
        langs += [model["languages"][b] if ok else UNDETERMINED for b, ok in zip(best, sure, strict=True)]
        scores.append(np.where(sure, score, 0.0))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def training_texts(labelled: DataFrame, text: str, lang: str, sample: int) -> DataFrame:
    """(l, h, t): of each language the distinct texts that it is learned from, with their hashes; see `fit`."""
    own = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    counts = materialize(own.groupBy("l").agg(F.approx_count_distinct("h").alias("n")))
    names = counts.count()
    most = max(1, min(TRAIN_BYTES, MODEL_BYTES // max(1, names)))
    # A bound on the hash lets about four times the sample through, of each language; ranks choose among those.
    counts = counts.select("l", (4.0 * (sample + 16) / F.greatest("n", F.lit(1))).alias("share"))
    low = own.join(F.broadcast(counts) if names <= FEW_LANGUAGES else counts, "l").where((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= F.col("share"))
    texts = low.groupBy("l", "h").agg(F.min("t").alias("t")).withColumn("b", F.octet_length("t").cast("long") + 2)
    order = W.partitionBy("l").orderBy(F.col("b") > most, "h")
    ranked = texts.withColumn("r", F.row_number().over(order)).withColumn("s", F.sum("b").over(order.rowsBetween(W.unboundedPreceding, 0)))
    chosen = ranked.where((F.col("r") == 1) | ((F.col("r") <= sample) & (F.col("s") <= most)))
    return chosen.select("l", "h", F.when(F.col("b") > most, F.substr("t", F.lit(1), F.lit(most))).otherwise(F.col("t")).alias("t"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = TRAIN_DOCS) -> dict:
    """The automata, from at most `sample` distinct texts of each language, read whole.

    They are the first by a hash of the text, so rows of one text count once and
    ties don't matter. Null languages and null or empty texts teach nothing. Each
    language takes TRAIN_BYTES of text at most, and all together MODEL_BYTES: longer texts
    come last, and what goes beyond is left out. Only where a language has no text
    within its share does it learn from the beginning of one.

    One task builds a language's automaton; the driver gets them as arrays, about
    30 bytes for each byte of text.
    """

    def build(t):
        rows = sorted(zip(t["h"].to_pylist(), t["t"].to_pylist(), strict=True))
        low, _ = normalize(*flat(pa.array([f" {x} " for _, x in rows])))
        if not low.tobytes().strip():
            return pa.table({"l": pa.array([], pa.string()), "states": pa.array([], pa.int64()), **{k: pa.array([], pa.binary()) for k in ("state", "symbol", "target")}})
        states, *arrays = transitions(low.tobytes())
        out = {"l": pa.array([t["l"][0].as_py()], pa.string()), "states": pa.array([states], pa.int64())}
        return pa.table(out | {k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("state", "symbol", "target"), arrays, strict=True)})

    built = training_texts(labelled, text, lang, sample).groupBy("l").applyInArrow(build, "l string, states long, state binary, symbol binary, target binary").collect()
    return assemble({r.l: (r.states, np.frombuffer(r.state, np.int32), np.frombuffer(r.symbol, np.uint8), np.frombuffer(r.target, np.int32)) for r in built})


def identify(docs: DataFrame, model: dict, text: str = "text", lang_pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """`docs` with the predicted language and its score (0 to 1).

    `und` with score 0 for null texts, texts without a letter, and where the
    model has no language. Ties go to the first language by name. Rows and
    other columns pass unchanged; an input column with one of the two names is
    replaced. An empty table gives an empty table. A text needs memory in
    proportion to its own length only.
    """
    docs = docs.drop(lang_pred, score)
    where, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores = predict(shared.value, b.column(where))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_pred, score])

    return docs.mapInArrow(tidy(run), extended(docs, **{lang_pred: StringType(), score: DoubleType()}))


def held_out(id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
