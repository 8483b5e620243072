"""Literal mentions: an Aho-Corasick automaton over all terms, sent once to every executor; texts pass it once."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all terms together that one automaton takes; more terms take further passes.
TERM_CHARS = 1 << 21
MARK = re.compile(r"\w")


def blocks_of(terms: DataFrame, term: str, most: int):
    """Distinct terms, a block of at most `most` characters at a time (a longer term alone)."""
    held, size = [], 0
    for r in terms.where(F.length(term) > 0).select(term).distinct().toLocalIterator():
        if held and size + len(r[0]) > most:
            yield held
            held, size = [], 0
        held.append(r[0])
        size += len(r[0])
    if held:
        yield held


def mentions(docs: DataFrame, terms: DataFrame, text: str, term: str, id: str, words: bool = False, most: int = TERM_CHARS) -> DataFrame:
    """(id, term, hits): for each row and each distinct term that its text holds, how often it stands there; overlapping places count each.

    With `words` a place counts only where no word goes on at either side of it:
    as with \\b, an end that is a word character must not touch another one.
    Null and empty terms and null texts give nothing. Terms are read in blocks of
    `most` characters, whose automaton the driver builds and sends; every block is
    a pass over the texts.
    """
    sc, out = docs.sparkSession.sparkContext, []
    kind = docs.schema[id].dataType.simpleString()
    for block in blocks_of(terms, term, most):
        automaton = ahocorasick.Automaton()
        for t in block:
            automaton.add_word(t, t)
        automaton.make_automaton()
        shared = sc.broadcast(automaton)

        def run(batches, shared=shared):
            found = shared.value
            for b in batches:
                at, named, hits = [], [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    counts: dict[str, int] = {}
                    for end, t in found.iter(text) if text else ():
                        if words:
                            begin = end + 1 - len(t)
                            glued = (begin and MARK.match(t[0]) and MARK.match(text[begin - 1])) or (end + 1 < len(text) and MARK.match(t[-1]) and MARK.match(text[end + 1]))
                            if glued:
                                continue
                        counts[t] = counts.get(t, 0) + 1
                    at += [k] * len(counts)
                    named += counts
                    hits += counts.values()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(named, pa.string()), pa.array(hits, pa.int64())], names=["id", "term", "hits"])

        out.append(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, term string, hits long"))
    if not out:
        return docs.sparkSession.createDataFrame([], f"`{id}` {kind}, term string, hits long")
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole.withColumnRenamed("id", id)
