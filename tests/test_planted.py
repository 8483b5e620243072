"""Queries that find nothing (or next to nothing) on the given tables, on tables with planted rows; a changed threshold or table changes the result."""

import random

import duckdb
import pytest

from corvid.functions.trees import DIGESTS
from corvid.plans import catalog, code_catalog, loop_catalog, operator_catalog, task_catalog, tree_catalog  # noqa: F401  they register their queries
from corvid.plans.catalog import QUERIES, SQL


def both(spark, folder, name):
    """Rows by Spark and by DuckDB over the tables in a folder."""
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"CREATE OR REPLACE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    mine = QUERIES[name](spark, str(folder))
    want = c.execute(f"SELECT {', '.join(mine.columns)} FROM ({SQL[name]})").fetchall()
    got = [tuple(r) for r in mine.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(float(x) if isinstance(x, float) else x for x in r) for r in want)))
    return got


def save(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")


@pytest.fixture
def near_texts(spark, tmp_path):
    """Twelve items, and of each a copy, two texts with few other words, and one with many."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items, docs = [], []
    for k in range(12):
        own = [word() for _ in range(400)]
        items.append((k, " ".join(own)))
        for n, changed in enumerate((0, 1, 3, 60)):
            text = list(own)
            for at in rng.sample(range(400), changed):
                text[at] = word()
            docs.append((10 * k + n, " ".join(text)))
    docs += [(900 + k, " ".join(word() for _ in range(50))) for k in range(20)] + [(990, None), (991, "")]
    save(spark, tmp_path, "benchmark", items, "item_id long, text string")
    save(spark, tmp_path, "documents", docs, "doc_id long, text string")
    return tmp_path


def test_near_signatures(spark, near_texts):
    near = {r[:2] for r in both(spark, near_texts, "q10_simhash_hamming")}
    assert {(10 * k, k) for k in range(12)} <= near and len(near) > 15 and all(d // 10 == i and d % 10 < 3 for d, i in near)
    agree = {(d, i): a for d, i, a in both(spark, near_texts, "q69_minhash_match")}
    assert {(10 * k, k) for k in range(12)} <= set(agree) and len(agree) > 15 and all(agree[10 * k, k] == 1 for k in range(12)) and min(agree.values()) < 1
    assert all(d // 10 == i and d % 10 < 3 for d, i in agree)


def test_rows_without_their_others(spark, tmp_path):
    save(spark, tmp_path, "documents", [(1,), (2,), (None,)], "doc_id long")
    save(spark, tmp_path, "labels", [(1,), (3,), (3,), (None,)], "doc_id long")
    assert sorted(both(spark, tmp_path, "q66_integrity_anti_join"), key=repr) == [(3,), (3,), (None,)]
    save(spark, tmp_path, "customer", [(7,), (8,)], "c_custkey long")
    save(spark, tmp_path, "events", [(1, 7), (2, 9), (3, None), (4, 8)], "event_id long, user_id long")
    assert sorted(both(spark, tmp_path, "q118_unknown_samples")) == [(2,), (3,)]


def test_name_mentions_and_overlaps(spark, tmp_path):
    """Snippets of parts whose names mention functions of other snippets."""
    rows = [(k, f"call fn{k - k % 10} now" if k % 10 == 3 else "plain", "Brand#1", "TYPE", 6 + k % 4) for k in range(60)]
    save(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    before = both(spark, tmp_path, "q112_name_mentions")
    assert all(len(r) == 4 for r in before)
    matches = both(spark, tmp_path, "q138_function_name_matches")
    assert matches and all(pairs >= same for _, _, pairs, same, _ in matches)


def test_matches_of_trees_and_patterns(spark, sf):
    """Benchmark trees that agree with others in all, in some and in none of their components."""
    digests = QUERIES["q125_tree_digest_matches"](spark, sf).collect()
    by = {}
    for r in digests:
        by.setdefault(r.bench_id, set()).add(r.component)
    assert set.union(*by.values()) == set(DIGESTS) and len({len(v) for v in by.values()}) > 3 and max(map(len, by.values())) == 8
    risks = QUERIES["q128_semantic_high_risk"](spark, sf).collect()
    parts = {r.same_components for r in risks}
    assert len({r.bench_id for r in risks}) >= 5 and any(len(p.split(",")) == 5 for p in parts)
