"""Readers and writers on small files: bad lines, blocks, duplicate keys, missing and incomplete inputs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from corvid.sources import lines, sinks


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    a, b = [f"line {k} " + "x" * (k % 90) for k in range(3000)], ["one", "", "three"]
    (tmp_path / "a.txt").write_text("\n".join(a) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(b))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = lines.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, want in (("a.txt", a), ("b.txt", b)):
        own = {r.line: r.value for r in got if r.file.endswith(name)}
        assert own == {k + 1: v for k, v in enumerate(want)}


GOOD = ['{"task_id": "a", "n": 1}', "", '{"task_id": "b", "n": 2}', '{"task_id": "a", "n": 3}']


def test_jsonl(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("\n".join(GOOD))
    with gzip.open(tmp_path / "g.jsonl.gz", "wt") as f:
        f.write("\n".join(GOOD))
    for name in ("g.jsonl", "g.jsonl.gz"):
        assert sorted((r.line, r.task_id, r.n) for r in lines.read_jsonl(spark, f"{tmp_path}/{name}").collect()) == [(1, "a", 1), (3, "b", 2), (4, "a", 3)]
    assert sorted((r.task_id, r.n, r.line) for r in lines.read_problems(spark, f"{tmp_path}/g.jsonl").collect()) == [("a", 3, 4), ("b", 2, 3)]
    assert [r.task_id for r in lines.read_problems(spark, f"{tmp_path}/g.jsonl", when=F.col("n") < 2).collect()] == ["a"]


def test_bad_jsonl_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_bytes(b'{"t": "x"}\n[1]\nnot json\n{"t": "y\xff"}\n{"t": {"deep": 1}\n7\n  {"t": "z"}\n')
    skipped = lines.read_jsonl(spark, f"{tmp_path}/b.jsonl", "t string", bad="skip").collect()
    assert sorted((r.line, r.t) for r in skipped) == [(1, "x"), (4, "y�"), (7, "z")]
    kept = lines.read_jsonl(spark, f"{tmp_path}/b.jsonl", "t string", bad="keep").collect()
    assert len(kept) == 7 and sum(r.t is None for r in kept) == 4
    with pytest.raises(Exception, match=r"no JSON object of the schema: .*b.jsonl:[2356]"):
        lines.read_jsonl(spark, f"{tmp_path}/b.jsonl", "t string").collect()
    with pytest.raises(ValueError):
        lines.read_jsonl(spark, f"{tmp_path}/b.jsonl", "t string", bad="?")


def test_validated(spark):
    df = spark.createDataFrame([("a", "p", None)], "task_id string, prompt string, task string")
    assert lines.validated(df, ["task_id", "prompt"], {"task": "", "kind": "k"}).first().asDict() == {"task_id": "a", "prompt": "p", "task": "", "kind": "k"}
    with pytest.raises(Exception, match="required field is missing: task_id, prompt"):
        lines.validated(spark.createDataFrame([(None, " ")], "task_id string, prompt string"), ["task_id", "prompt"]).collect()


def test_splits(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": 1, "a": "", "b": "x"}\n\n{"id": 2, "a": "y", "b": "z"}\n')
    (tmp_path / "d.jsonl").write_text('{"id": 3, "b": null}\n')
    got = lines.in_input_order(lines.read_splits(spark, {"dev": f"{tmp_path}/d.jsonl", "train": f"{tmp_path}/t.jsonl"}, fields={"text": ["a", "b"]})).collect()
    assert [(r.split, r.row_index, r.id, r.text, r.dataset) for r in got] == [("train", 1, 1, "x", "core"), ("train", 3, 2, "y", "core"), ("dev", 1, 3, "", "core")]


def test_items_and_benchmarks(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("".join(f'{{"id": {k}}}\n' for k in range(40)))
    (tmp_path / "d.jsonl").write_text('{"id": 100}\n\n{"id": 101}\n')
    got = lines.read_items(spark, {"train": f"{tmp_path}/t.jsonl", "dev": f"{tmp_path}/d.jsonl"}).collect()
    assert sorted((r._idx, r.split, r.row_index, r.id) for r in got) == [(k + 1, "train", k + 1, k) for k in range(40)] + [(41, "dev", 1, 100), (42, "dev", 3, 101)]
    (tmp_path / "a.jsonl").write_text('{"task": "x", "intrinsic": "sve", "code": "c"}\n{"task": "y", "intrinsic": "NEON"}\n{"task": "z", "intrinsic": ""}\n')
    (tmp_path / "b.jsonl").write_text('{"name": "n", "serial": "s", "code": ""}\n')
    rows = lines.read_benchmarks(spark, {"a": (f"{tmp_path}/a.jsonl", {"id": ["task"], "scalar": ["code"]}), "b": (f"{tmp_path}/b.jsonl", {"id": ["name"], "scalar": ["code", "serial"]})}).collect()
    assert sorted((r.dataset, r.split, r.row_index, r.id, r.scalar) for r in rows) == [("a", "benchmark", 1, "x", "c"), ("a", "benchmark", 3, "z", ""), ("b", "benchmark", 1, "n", "s")]


def test_files_and_documents(spark, tmp_path):
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    (deep / "remote_a.json").write_text('{"final": {"n": 1}}')
    (deep / "other.txt").write_text("no")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "many.ast").write_text('{"a": 1}\n[2, {"b": 3}] "s"\n{broken')
    found = lines.files_under(spark, [f"{tmp_path}/x", f"{tmp_path}/missing", f"{tmp_path}/many.ast"]).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["many.ast", "remote_a.json"]
    assert lines.files_under(spark, [f"{tmp_path}/missing"]).count() == 0
    docs = lines.read_json_documents(spark, [f"{tmp_path}/bad.json", f"{deep}/remote_a.json"], "final struct<n: int>").collect()
    assert sorted(str(r.document and r.document.final and r.document.final.n) for r in docs) == ["1", "None"]
    got = lines.read_concatenated_json(spark, f"{tmp_path}/many.ast").orderBy("ordinal").collect()
    assert [json.loads(r.document) for r in got] == [{"a": 1}, [2, {"b": 3}], "s"]


def test_tasks(spark, tmp_path):
    for task, names in (("Task_10", ["a.txt", "b.cpp"]), ("Task_2", ["a.txt", "b.cpp"]), ("Task_x", ["a.txt", "b.cpp"]), ("Task_3", ["a.txt"]), ("Other_1", ["a.txt"])):
        (tmp_path / task).mkdir()
        for n in names:
            (tmp_path / task / n).write_text(f"{task}/{n}")
    whole, part = lines.read_tasks(spark, str(tmp_path), ["a.txt", "b.cpp"], "Task_")
    assert [(r.task, r.a, r.b) for r in whole.collect()] == [(t, f"{t}/a.txt", f"{t}/b.cpp") for t in ("Task_2", "Task_10", "Task_x")]
    assert [tuple(r) for r in part.collect()] == [("Task_3", "b.cpp")]


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.iterdir()) if p.name.startswith("part-"))


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", "x\ny", 1), (None, "z", 2)], "s string, t string, n int").coalesce(1)
    sinks.write_tsv(df, f"{tmp_path}/all")
    assert text_of(tmp_path / "all") == "s\tt\tn\na\tb\tx\\ny\t1\n\tz\t2\n"
    sinks.write_tsv(df, f"{tmp_path}/some", ["n", "t", "q", "s"])
    assert text_of(tmp_path / "some") == "n\tt\tq\ts\n1\tx y\t\ta b\n2\tz\t\t\n"
    sinks.write_tsv(df.limit(0), f"{tmp_path}/none")
    assert text_of(tmp_path / "none") == ""


def test_tsv_in_ordered_parts(spark, tmp_path):
    """Many tasks, one table: parts in the order of their names, and the same in one file; a second run takes the place of the first."""
    wide = spark.range(0, 5000, numPartitions=7).select("id", F.concat(F.lit("v"), "id").alias("v"))
    for rows in (5000, 1234):
        assert sinks.write_tsv(wide.where(f"id < {rows}"), f"{tmp_path}/wide") == rows
        want = "id\tv\n" + "".join(f"{k}\tv{k}\n" for k in range(rows))
        assert text_of(tmp_path / "wide") == want
        sinks.joined(spark, f"{tmp_path}/wide", f"{tmp_path}/one.tsv")
        assert (tmp_path / "one.tsv").read_text() == want
        # A header and a part of each task that has rows.
        assert len(list((tmp_path / "wide").glob("part-*"))) == (8 if rows == 5000 else 3)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["one.tsv", "wide"]
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/one.tsv").count() == 1234


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, None), ("y", 2, ["q"])], "b string, a int, c array<string>")
    assert sinks.write_jsonl(df.coalesce(1), f"{tmp_path}/j", sort_keys=True) == 2
    assert text_of(tmp_path / "j").splitlines()[0] == '{"a":1,"b":"x","c":null}'
    sinks.write_jsonl(df, f"{tmp_path}/j", append=True, gzip=True)
    back = spark.read.json(f"{tmp_path}/j")
    assert sorted(back.groupBy("a").count().collect()) == [(1, 2), (2, 2)]


def test_outputs_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "dataset string, n int")
    assert sinks.write_outputs({"x": df, "y": df.limit(1)}, f"{tmp_path}/o") == {"x": 3, "y": 1}
    assert json.loads(text_of(tmp_path / "o" / "manifest.json")) == {"outputs": {"x": 3, "y": 1}, "rows": 4}
    sinks.write_features(df, f"{tmp_path}/f")
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.is_dir()) == ["dataset=a", "dataset=b"]
    assert sinks.markdown_summary("T", {"C": df.groupBy("dataset").count().orderBy("dataset")}).splitlines()[2:] == ["## C", "", "| dataset | count |", "|---|---|", "| a | 2 |", "| b | 1 |"]
    with pytest.raises(ValueError):
        sinks.markdown_summary("T", {"C": spark.range(sinks.SUMMARY_ROWS + 1)})
    merged = sinks.merged_shards({3: df.limit(1), 1: df.where("n > 1")}, "n")
    assert [(r.shard, r.n) for r in merged.collect()] == [(1, 2), (1, 3), (3, 1)]
