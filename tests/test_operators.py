"""Hand-computed cases of the operators."""

from pyspark.sql import functions as F

from corvid.functions import text
from corvid.operators import evaluation, ordering, similarity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_shingles(spark):
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    assert one(spark, text.shingles(words("a", "b", "c", "d"), 5)) == ["a", "b", "c", "d"]
    assert one(spark, text.shingles(words(*"abcde"), 5)) == ["a b c d e"]
    assert one(spark, text.shingles(words(*"aaaaaa"), 5)) == ["a a a a a"]


def test_tokens_are_unicode_after_an_ascii_letter(spark):
    assert one(spark, text.tokens(F.lit("Iechä ñoo 12"))) == ["iechä", "oo", "12"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_hash_and_names(spark):
    assert one(spark, text.file_name(F.lit("__"))) == "task"
    assert one(spark, text.compact(F.lit(" a \n b "))) == "a b"
    assert one(spark, text.source_prefix(F.lit("abc.def"))) == "abc"
    assert one(spark, text.clean_items(F.array(*(F.lit(x) for x in (" a", "", "b", "a"))), 5)) == ["a", "b"]


def test_blake_signatures(spark):
    r = one(spark, similarity.blake_signatures(F.array(F.lit("a b c d e"))))
    unsigned = [v % 2**64 for v in r.minhash]
    assert r.simhash == 5979459495586277443
    assert unsigned[:2] == [15030818100457545158, 14716683202971849388]
    assert one(spark, similarity.blake_signatures(F.array().cast("array<string>"))).minhash == [0] * 64


def test_edit_ratio(spark):
    pair = [F.array(*(F.lit(x) for x in s)) for s in ("abcd", "bcde")]
    assert one(spark, similarity.edit_ratio(*pair)) == 0.75


def test_pass_at_k(spark):
    assert abs(one(spark, evaluation.pass_at(F.lit(10), F.lit(2), 5)) - (1 - 56 / 252)) < 1e-12
    assert one(spark, evaluation.pass_at(F.lit(5), F.lit(3), 3)) == 1.0
    df = spark.createDataFrame([(1, True)], "t int, ok boolean")
    assert [tuple(r) for r in evaluation.pass_at_k(df, "t", "ok").orderBy("k").collect()] == [(1, 0.2), (5, 1.0)]


def test_trimmed_mean(spark):
    of = lambda *v: one(spark, evaluation.trimmed_mean(F.array(*(F.lit(float(x)) for x in v))))
    assert of(1, 2, 3, 4, 5) == 3.0
    assert of(1, 2, 3, 4) == 2.5


def test_enclosing(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 1, 9), (3, 2, 3)], "id int, b int, e int").withColumn("k", F.lit(1))
    found = ordering.enclosing(df, "k", "b", "e", "id", 4).groupBy("id").agg(F.min(F.struct("width", "parent")).alias("p")).select("id", "p.parent")
    assert {tuple(r) for r in found.collect()} == {(3, 2), (2, 1)}


def test_as_of(spark):
    df = spark.createDataFrame([(3, "w"), (7, "w"), (9, "l"), (1, "l")], "at int, kind string").withColumn("k", F.lit(1))
    out = ordering.previous_match(df, ["k"], ["at"], F.col("kind") == "w", F.col("at"), "seed").where("kind = 'l'")
    assert {(r["at"], r.seed) for r in out.collect()} == {(9, 7), (1, None)}


def test_contiguous_shards(spark):
    out = ordering.contiguous_shards(spark.range(10).repartition(3), "id", 3).collect()
    assert {(r.id, r.shard) for r in out} == {(i, i // 4) for i in range(10)}
