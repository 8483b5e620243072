"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens are lower-cased words. The network reads the classes of the two words
before and the two after a position and predicts the class of the word there;
within its class a word has its share of the corpus. A document's score is the
sum of the log-probabilities of all its words, each given both sides.

Word counts cover the whole corpus. The network is trained in numpy on the
executors: a hash of the text deals the documents to STEPS batches, and each
batch's gradient, summed over every position of its texts, makes one step. So
the weights depend on the corpus, not on its order or its partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType

from corvid.llm.frames import extended, unused
from corvid.llm.textbytes import LOWER, flat, mix, slices, words
from corvid.llm.toplist import count_cut
from corvid.sources.tables import materialize

#: Frequent words that are a class of their own; the others fall into SUFFIXES classes by their last three bytes.
OWN, SUFFIXES = 128, 64
CLASSES = OWN + SUFFIXES
#: Words whose shares go to every executor; the counts of the others are joined to the words that texts hold.
VOCABULARY = 1 << 15
SIDE, EMBED, HIDDEN = 2, 8, 16
STEPS, RATE = 16, 0.1
PAD = CLASSES
#: Precision of a step of the gradient.
KIND = np.float32
SHAPES = {"e": (CLASSES + 1, EMBED), "w": (2 * SIDE * EMBED, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, CLASSES), "c": (CLASSES,)}


def pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpack(flat_weights) -> dict:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = np.asarray(flat_weights[at : at + n]).reshape(shape)
        at += n
    return out


def first_weights(total: np.ndarray | None = None, seed: int = 17) -> np.ndarray:
    """Small random weights; the output bias is that of the classes' totals, where given."""
    rng = np.random.default_rng(seed)
    p = {k: rng.standard_normal(s) * 0.1 * (len(s) > 1) for k, s in SHAPES.items()}
    if total is not None:
        p["c"] = np.log((total + 1) / (total.sum() + CLASSES))
    return pack(p)


def suffix_class(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """OWN to CLASSES - 1 by the last three bytes (A-Z lowered) of each word."""
    end = start + length - 1
    code = np.zeros(len(start), np.uint64)
    for back in range(3):
        code = code * np.uint64(256) + np.where(length > back, LOWER[data[np.maximum(end - back, 0)]], 0).astype(np.uint64)
    return (OWN + (mix(code) % np.uint64(SUFFIXES)).astype(np.int64)) if len(start) else np.zeros(0, np.int64)


def tokens(column: pa.Array):
    """(word hashes, suffix classes, words of each row)."""
    data, offsets = flat(column)
    hashed, length, start, n = words(data, offsets)
    return hashed, suffix_class(data, start, length), n


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, cls, n) over all texts; counts are merged on the way in each partition."""

    def run(batches):
        held, many = [], 0

        def merged():
            word = np.concatenate([h for h, _ in held])
            cls = np.concatenate([c for _, c in held])
            unique, at, count = np.unique(word, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(cls[at].astype(np.int32)), pa.array(count)], names=["word", "cls", "n"])

        for b in batches:
            for lo, hi in slices(b.column(0)):
                hashed, cls, _ = tokens(b.column(0).slice(lo, hi - lo))
                held.append((hashed, cls))
                many += len(hashed)
                if many >= 1 << 21:
                    yield merged()
                    held, many = [], 0
        if many:
            yield merged()

    return docs.select(text).mapInArrow(run, "word long, cls int, n long").groupBy("word", "cls").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str) -> dict:
    """The part of the lexicon that goes to every executor."""
    return lexicon_and_others(docs, text)[0]


def lexicon_and_others(docs: DataFrame, text: str) -> tuple[dict, DataFrame | None]:
    """Classes and in-class log shares of at most VOCABULARY most frequent words (all above a count, the smaller hash first on ties), each class's share of a word seen once, and (word, n) of the other words seen more often, if there are any."""
    counts = materialize(word_counts(docs, text))
    cut = count_cut(counts, "n", VOCABULARY)
    top = sorted(counts.where(F.col("n") >= F.lit(cut)).collect(), key=lambda r: (-r.n, r.word))
    # CLASSES rows at most.
    total = np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("total")).collect():
        total[r.cls] = r.total
    word = np.array([r.word for r in top], np.int64).view(np.uint64)
    count = np.array([r.n for r in top], float)
    cls = np.array([r.cls for r in top], np.int64)
    np.subtract.at(total, cls[:OWN], count[:OWN])
    cls[:OWN] = np.arange(min(OWN, len(cls)))
    total[: min(OWN, len(cls))] = count[:OWN]
    # One count more per class stands for words that the corpus lacks.
    share = np.log(count / (total[cls] + 1)) if len(cls) else count
    order = np.argsort(word)
    others = counts.where((F.col("n") < F.lit(cut)) & (F.col("n") > 1)).groupBy("word").agg(F.sum("n").alias("n"))
    return {"word": word[order], "cls": cls[order], "share": share[order], "rest": -np.log(total + 1), "total": total}, None if others.isEmpty() else others


def listed(lex: dict, hashed: np.ndarray) -> np.ndarray:
    """Which words `lex` holds."""
    if not len(lex["word"]):
        return np.zeros(len(hashed), bool)
    return lex["word"][np.minimum(np.searchsorted(lex["word"], hashed), len(lex["word"]) - 1)] == hashed


def classed(lex: dict, hashed: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, log share within the class) of each word; words that `lex` lacks have the share of a word seen once."""
    if not len(lex["word"]):
        return suffix, lex["rest"][suffix]
    at = np.minimum(np.searchsorted(lex["word"], hashed), len(lex["word"]) - 1)
    known = lex["word"][at] == hashed
    cls = np.where(known, lex["cls"][at], suffix)
    return cls, np.where(known, lex["share"][at], lex["rest"][cls])


def contexts(cls: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[word, 2 * SIDE] classes around each word; PAD beyond the text's ends."""
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(cls))
    out = np.full((len(cls), 2 * SIDE), PAD, np.int32)
    for k, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to = at + shift
        ok = (to >= (ends - n)[row]) & (to < ends[row])
        out[ok, k] = cls[to[ok]]
    return out


def outputs(p: dict, kind: type) -> tuple[np.ndarray, ...]:
    """The weights as (e, w, b, v over c) of a float kind; c is the last row of the output weights, for a hidden unit that is always one."""
    return p["e"].astype(kind), p["w"].astype(kind), p["b"].astype(kind), np.concatenate([p["v"], p["c"][None]]).astype(kind)


def hidden(e: np.ndarray, w: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, hidden units with the one beside them) of contexts."""
    x = e[near].reshape(len(near), -1)
    h = np.ones((len(near), HIDDEN + 1), x.dtype)
    np.tanh(x @ w + b, out=h[:, :HIDDEN])
    return x, h


def log_probabilities(p: dict, around: np.ndarray, cls: np.ndarray, step: int = 1 << 11) -> np.ndarray:
    """Of each word's class, given its context. STEPS steps of at most RATE keep all scores far from overflow, so none is shifted by its row's largest."""
    e, w, b, v = outputs(p, np.float32)
    out = np.zeros(len(cls))
    for lo in range(0, len(cls), step):
        z = hidden(e, w, b, around[lo : lo + step])[1] @ v
        own = z[np.arange(len(z)), cls[lo : lo + step]]
        out[lo : lo + step] = own - np.log(np.exp(z, out=z).sum(axis=1))
    return out


def gradient(p: dict, around: np.ndarray, cls: np.ndarray, step: int = 1 << 10) -> np.ndarray:
    """The packed gradient of the summed cross entropy; steps are worked out in KIND and summed in double precision."""
    e, w, b, v = outputs(p, KIND)
    out = {k: np.zeros(s) for k, s in SHAPES.items()}
    sums = np.zeros(v.shape)
    for lo in range(0, len(cls), step):
        near, own = around[lo : lo + step], cls[lo : lo + step]
        x, h = hidden(e, w, b, near)
        z = h @ v
        scale = 1 / np.exp(z, out=z).sum(axis=1)[:, None]
        # Probabilities are z * scale; the words' own classes come off apart.
        sums += (h * scale).T @ z
        dh = ((z @ v[:-1].T) * scale - v[:-1, own].T) * (1 - h[:, :-1] ** 2)
        dx = (dh @ w.T).reshape(-1, EMBED)
        for k in range(HIDDEN + 1):
            sums[k] -= np.bincount(own, h[:, k], minlength=CLASSES)
        for k in range(EMBED):
            out["e"][:, k] += np.bincount(near.ravel(), dx[:, k], minlength=CLASSES + 1)
        out["w"] += x.T @ dh
        out["b"] += dh.sum(axis=0)
    out["v"], out["c"] = sums[:-1], sums[-1]
    return pack(out)


def classes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all words, words of each row) of what `prepared` packed."""
    parts = [np.frombuffer(x or b"", np.uint8) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(np.int64), np.array([len(x) for x in parts], np.int64)


def prepared(docs: DataFrame, lex: dict, text: str, names: list[str], keep_text: bool, open_words: bool) -> DataFrame:
    """`docs` with, under `names`: batch number, class of every word, words, sum of log shares, and the words that `lex` lacks."""
    assert CLASSES < 256
    columns = [c for c in docs.columns if c != text or keep_text]
    dealt = docs.withColumn(names[0], F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(STEPS)).cast("int"))
    where, keep, shared = docs.columns.index(text), [docs.columns.index(c) for c in columns], docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        lex = shared.value
        for b in batches:
            packs, sizes, sums = [], [np.zeros(0, np.int64)], [np.zeros(0)]
            rare, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi in slices(b.column(where)):
                hashed, suffix, n = tokens(b.column(where).slice(lo, hi - lo))
                cls, share = classed(lex, hashed, suffix)
                row = np.repeat(np.arange(hi - lo), n)
                ends = np.cumsum(n).tolist()
                whole = cls.astype(np.uint8).tobytes()
                packs += [whole[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                sizes.append(n)
                sums.append(np.bincount(row, share, minlength=hi - lo))
                out = ~listed(lex, hashed) if open_words else np.zeros(len(hashed), bool)
                rare.append(hashed[out])
                counts.append(np.bincount(row[out], minlength=hi - lo))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare).view(np.int64)))
            found = [pa.array(packs, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums)), words]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), b.column(b.num_columns - 1), *found], names=[*columns, *names])

    kinds = dict(zip(names, (IntegerType(), BinaryType(), LongType(), DoubleType(), ArrayType(LongType())), strict=True))
    return dealt.mapInArrow(run, extended(docs.select(*columns), **kinds))


def train(prep: DataFrame, lex: dict, batch: str, cls: str) -> np.ndarray:
    """Weights after one step of Adam for each batch of `prepared` documents; a batch without a word makes none."""
    spark = prep.sparkSession
    weights = first_weights(lex["total"])
    m, v, taken = np.zeros_like(weights), np.zeros_like(weights), 0
    for turn in range(STEPS):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches, shared=shared):
            p, sums, seen = unpack(shared.value), np.zeros(len(shared.value)), 0
            for b in batches:
                lo = 0
                while lo < b.num_rows:
                    # Some rows at a time, so that contexts need bounded memory but for one text's own.
                    hi, many = lo, 0
                    while hi < b.num_rows and (hi == lo or many < 1 << 16):
                        many += len(b.column(0)[hi].as_py())
                        hi += 1
                    own, n = classes_of(b.column(0).slice(lo, hi - lo))
                    sums += gradient(p, contexts(own, n), own)
                    seen, lo = seen + len(own), hi
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([float(seen)])], names=["g", "n"])

        # The sums are taken by position, so what reaches the driver doesn't grow with the partitions.
        own = prep.where(F.col(batch) == turn).select(cls).mapInArrow(run, "g array<double>, n double")
        rows = own.select("n", F.posexplode("g").alias("k", "g")).groupBy("k").agg((F.sum("g") / F.sum("n")).alias("g")).collect()
        if rows:
            g = np.zeros_like(weights)
            g[[r.k for r in rows]] = [r.g for r in rows]
            taken += 1
            m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
            rate = RATE * (1 - 0.8 * turn / STEPS)
            weights = weights - rate * (m / (1 - 0.8**taken)) / (np.sqrt(v / (1 - 0.95**taken)) + 1e-4)
    return weights


def inner_names(docs: DataFrame) -> list[str]:
    return unused(docs, "lm_batch", "lm_classes", "lm_words", "lm_share", "lm_rare")


def fit(docs: DataFrame, text: str = "text") -> dict:
    """Lexicon and network weights of a corpus. An empty corpus gives a model that knows no word."""
    lex, others = lexicon_and_others(docs, text)
    own = docs.select(text)
    names = inner_names(own)
    prep = materialize(prepared(own, lex, text, names, False, False).select(*names[:2]))
    return {"lex": lex, "weights": train(prep, lex, *names[:2]), "others": others}


def scored(prep: DataFrame, model: dict, names: list[str], columns: list[str]) -> DataFrame:
    """`columns` of `prepared` documents with the three score columns. With other words to be joined, `prep` has to be written already."""
    _, cls, tokens_, share, rare = names
    others, shared = model.get("others"), prep.sparkSession.sparkContext.broadcast(model["weights"])
    picked = prep.select(*columns, cls, share, rare, F.col(tokens_).alias("lm_tokens"))
    at = len(columns)

    def run(batches):
        p = unpack(shared.value)
        for b in batches:
            total = b.column(at + 1).to_numpy(zero_copy_only=False).copy()
            lo = 0
            while lo < b.num_rows:
                hi, many = lo, 0
                while hi < b.num_rows and (hi == lo or many < 1 << 16):
                    many += len(b.column(at)[hi].as_py())
                    hi += 1
                own, n = classes_of(b.column(at).slice(lo, hi - lo))
                total[lo:hi] += np.bincount(np.repeat(np.arange(hi - lo), n), log_probabilities(p, contexts(own, n), own), minlength=hi - lo)
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), b.column(at + 2), b.column(at + 3), pa.array(total)], names=[*columns, rare, "lm_tokens", "lm_logprob"])

    out = picked.mapInArrow(run, extended(prep.select(*columns), **{rare: ArrayType(LongType()), "lm_tokens": LongType(), "lm_logprob": DoubleType()}))
    if others is not None:
        # Rows are numbered once, in what is written, so that the sums find them again.
        row, more = unused(out, "lm_row", "lm_more")
        out = materialize(out.withColumn(row, F.monotonically_increasing_id()))
        sums = out.select(row, F.explode(rare).alias("word")).join(others, "word").groupBy(row).agg(F.sum(F.log("n")).alias(more))
        out = out.join(sums, row, "left").withColumn("lm_logprob", F.col("lm_logprob") + F.coalesce(more, F.lit(0.0)))
    return out.select(*columns, "lm_tokens", "lm_logprob", F.when(F.col("lm_tokens") > 0, F.col("lm_logprob") / F.col("lm_tokens")).alias("lm_mean"))


def score(docs: DataFrame, model: dict, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with lm_tokens, lm_logprob (sum over all words) and lm_mean (per word).

    Null, empty or blank texts have no words: 0, 0.0 and a null mean. Rows and
    other columns pass unchanged, whatever their names; an input column of a
    new name is replaced. An empty table gives an empty table. Without
    `keep_text` the text is left out, which spares its copy where other words'
    counts have to be joined.
    """
    docs = docs.drop("lm_tokens", "lm_logprob", "lm_mean")
    names = inner_names(docs)
    prep = prepared(docs, model["lex"], text, names, keep_text, model.get("others") is not None)
    return scored(prep, model, names, [c for c in docs.columns if c != text or keep_text])


def fit_and_score(docs: DataFrame, text: str = "text") -> DataFrame:
    """`score` of `docs`, without their text, under a model of themselves; words are looked up once for both."""
    docs = docs.drop("lm_tokens", "lm_logprob", "lm_mean")
    lex, others = lexicon_and_others(docs, text)
    names = inner_names(docs)
    prep = materialize(prepared(docs, lex, text, names, False, others is not None))
    return scored(prep, {"weights": train(prep, lex, *names[:2]), "others": others}, names, [c for c in docs.columns if c != text])


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a model of all of them."""
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
