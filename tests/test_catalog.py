"""Every catalog query with SQL agrees with DuckDB on the smallest tables."""

import decimal
import difflib
import hashlib
import os

import duckdb
import pandas as pd
import pytest
import regex

from corvid.plans import code_catalog, loop_catalog, operator_catalog, task_catalog, tree_catalog  # noqa: F401  they register their queries
from corvid.plans.catalog import QUERIES, SQL


def rows(df):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6)
        return v.item() if hasattr(v, "item") else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_duckdb(spark, sf, duck, name):
    mine, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def plain_tokens(text):
    return regex.findall(r"[a-z_][\p{L}\p{N}_]*|[0-9]+", (text or "").lower())


def test_blake_signatures_by_hand(spark, sf):
    """MinHash and SimHash of every benchmark item and some documents, against plain integers."""
    h64 = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
    seeds = [h64(f"seed_{k}") for k in range(64)]
    texts = {("bench", r.item_id): r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts |= {("core", r.doc_id): r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()}
    got = {(r.dataset, r.id): r for r in QUERIES["q09_minhash_blake2b"](spark, sf).collect()}
    assert len(got) == 240
    for key, text in texts.items():
        t = plain_tokens(text)
        hashes = [h64(s) for s in ({" ".join(t[k : k + 5]) for k in range(len(t) - 4)} if len(t) >= 5 else set(t))]
        slots = [min(((h ^ seed) * 11400714819323198485) % 2**64 for h in hashes) for seed in seeds] if hashes else [0] * 64
        assert [v % 2**64 for v in got[key].minhash] == slots
        assert got[key].simhash % 2**64 == sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in hashes) > 0)


def test_edit_similarity_by_hand(spark, tmp_path):
    """Pairs that share shingles, with the ratio of their tokens at or above 0.88, against difflib on every pair."""
    base = [f"word{k}" for k in range(60)]
    docs = [" ".join(base), " ".join([*base[:50], "other", *base[51:]]), " ".join(base[:55]), " ".join([*base[30:], *base[:30]]), "nothing shared here", " ".join([*base, *base]), ""]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[20:]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.edit_similarity for r in QUERIES["q11_edit_similarity"](spark, str(tmp_path)).collect()}
    hits = {(r.doc_id, r.item_id) for r in QUERIES["q01_shingle_containment"](spark, str(tmp_path)).collect()}
    ratio = lambda d, i: difflib.SequenceMatcher(None, plain_tokens(docs[d]), base if i == 1 else base[20:], autojunk=False).ratio()
    assert got == {(d, i): round(ratio(d, i), 6) for d, i in hits if ratio(d, i) >= 0.88}
    assert {(0, 1), (1, 1), (2, 1)} & hits and len(got) >= 2 and len(hits) > len(got)


def test_every_term_is_looked_for(spark, tmp_path):
    spark.createDataFrame([(f"Term{k:04d}.",) for k in range(1500)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(f"the term{k:04d}. here",) for k in range(1500)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["q17_literal_mention"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(f"Term{k:04d}.", 1) for k in range(1500)}
