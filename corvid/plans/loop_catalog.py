"""Queries of loop regions: kinds of loops by what their functions' records say.

The tables hold no code, so every row of `part` takes one of the records below, with
names and numbers of its own. What each loop is was decided by hand: it stands beside its
record, and is all that the SQL knows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import loops, regions
from corvid.operators import nesting
from corvid.plans.registry import query
from corvid.sources.tables import materialize, spread, table

HEAD, UP, BACK = "for (int @v = 0; @v < n; ++@v)", "for (int @v = 1; @v < n; ++@v)", "while (lo < hi)"


def ref(text: str) -> dict:
    base, _, index = text.partition("[")
    return {"base": base, "index": index.removesuffix("]")}


def item(at: int, text: str, writes: str = "", reads: str = "", **more) -> dict:
    """`lhs op rhs` at a place, with the elements that it writes and reads, parted by blanks."""
    lhs, op, rhs = text.split(" ", 2)
    return {"begin": at, "lhs": lhs, "op": op, "rhs": rhs, "writes": [ref(w) for w in writes.split()], "reads": [ref(r) for r in reads.split()]} | more


def own(at: int, text: str, reads: str = "") -> dict:
    return item(at, text, "", reads, declared=True)


def record(header: str, items: list, branches=(), controls=(), returns=(), calls=(), inner=(), kind="ForStmt", snippet="", types=None) -> str:
    """The loop is at places 100 to 900."""
    every = [{"begin": 100, "end": 900, "kind": kind, "header": header, "snippet": snippet or header}, *({"begin": b, "end": e, "kind": k, "header": h, "snippet": h} for b, e, h, k in inner)]
    return json.dumps({
        "loops": every, "items": items, "branches": [{"begin": b, "end": e, "cond": c} for b, e, c in branches], "controls": [{"begin": b, "kind": k} for b, k in controls],
        "returns": [{"begin": b} for b in returns], "calls": [{"begin": b, "name": n} for b, n in calls], "types": types or {},
    })


IN = "for (int k = 0; k < m; ++k)"
STORE = item(200, "a[@v] = b[@v]*2", "a[@v]", "b[@v]")
#: (record, kind of its loop, whether that runs as a vector loop, kinds of its inner loops).
RECORDS = [
    (record(BACK, [item(200, "a[lo] = a[hi]", "a[lo]", "a[hi]"), item(210, "a[hi] = t", "a[hi]"), item(220, "lo += 1"), item(230, "hi -= 1")], kind="WhileStmt"), "two_pointer_swap", True, []),
    (record(BACK, [item(200, "a[lo] = a[hi]", "a[lo]", "a[hi]"), item(220, "lo += 1"), item(230, "hi -= 1")], kind="WhileStmt"), "pseudocode_control", False, []),
    (record("do", [item(200, "x = 1")], kind="DoStmt"), "pseudocode_control", False, []),
    (record(HEAD, [own(150, "s = 0"), item(300, "s += b[k]", "", "b[k]"), item(500, "a[@v] = s", "a[@v]")], branches=[(480, 520, "s > 0")], inner=[(200, 400, "for (int k = 0; k < @v; ++k)", "ForStmt")]), "hybrid_scalar_region_per_element", True, ["scalar_reduction"]),
    (record(HEAD, [STORE], branches=[(190, 300, "b[@v] > @n")], controls=[(250, "BreakStmt")]), "pseudocode_loop", False, []),
    (record(HEAD, [STORE], branches=[(190, 300, "c++ > @n")]), "pseudocode_loop", False, []),
    (record(HEAD, [STORE], branches=[(190, 300, "(c = b[@v]) > @n")]), "pseudocode_loop", False, []),
    (record(HEAD, [item(200, "s += b[@v]", "", "b[@v]"), item(260, "a[@v] = s", "a[@v]")], branches=[(300, 400, "s > @n")], returns=[350]), "prefix_scan_predicate", True, []),
    (record(HEAD, [item(200, "s += b[@v]", "", "b[@v]"), item(260, "a[@v] = s + 1", "a[@v]")]), "pseudocode_loop", False, []),
    (record(HEAD, [item(300, "total += b[k]", "", "b[k]")], inner=[(200, 400, IN, "ForStmt")]), "hybrid_elementwise_reduction", True, ["scalar_reduction"]),
    (record(HEAD, [item(200, "s += b[@v]", "", "b[@v]")], branches=[(300, 400, "s > @n")], returns=[350]), "prefix_scan_predicate", True, []),
    (record(HEAD, [item(210, "d += 1")], branches=[(200, 220, "b[@v] == 1"), (300, 400, "d < 0")], returns=[350]), "prefix_scan_predicate", True, []),
    (record(HEAD, [item(200, "best = b[@v]", "", "b[@v]")], branches=[(190, 300, "b[@v] > best")]), "pseudocode_loop", False, []),
    (record(HEAD, [item(200, "hits += 1"), STORE], branches=[(190, 300, "b[@v] > @n")]), "pseudocode_loop", False, []),
    (record(HEAD, [own(150, "s = 0"), item(310, "s = s+c[@v]", "", "c[@v]"), item(500, "a[@v] = s", "a[@v]", "b[@v]")], branches=[(300, 320, "k > @n")], inner=[(200, 400, IN, "ForStmt")]), "hybrid_scalar_region_per_element", True, ["pseudocode_loop"]),
    (record(HEAD, [item(310, "s = s|c[k]", "", "c[k]")], branches=[(300, 320, "k > @n")], calls=[(450, "std::sort")], inner=[(200, 400, IN, "ForStmt")]), "pseudocode_loop", False, ["pseudocode_loop"]),
    (record(HEAD, [item(200, "found = 1")], branches=[(190, 300, "b[@v] == @n")], controls=[(600, "BreakStmt")]), "bounded_predicate_scan", True, []),
    (record(HEAD, [own(150, "x = b[@v]", "b[@v]")], branches=[(190, 300, "x == @n")], returns=[250]), "predicate_return_scan", True, []),
    (record(HEAD, [own(150, "x = b[@v]", "b[@v]")], branches=[(190, 300, "t[@v] == @n")], returns=[250], types={"t": "std::string"}), "pseudocode_loop", False, []),
    (record(HEAD, [item(200, "best_idx = @v")], branches=[(190, 300, "b[@v] == @n")]), "arg_reduction", True, []),
    (record(HEAD, [item(200, "pair = {@v, k}")], branches=[(190, 300, "b[@v] == @n")], types={"pair": "std::vector<int>"}), "arg_reduction", True, []),
    (record(HEAD, [item(200, "seen = true")], branches=[(190, 300, "b[@v] == @n")]), "arg_reduction", True, []),
    (record(HEAD, [item(200, "x = b[@v]", "", "b[@v]")], branches=[(190, 300, "c[@v] == @n")]), "pseudocode_loop", False, []),
    (record(HEAD, [STORE], branches=[(190, 300, "f(@v)")], returns=[700], snippet="for (...) { v.push_back(1); }"), "pseudocode_loop", False, []),
    (record(UP, [item(50, "a[0] = @n", "a[0]"), item(200, "a[@v] = a[@v-1]+@n", "a[@v]", "a[@v-1]")]), "affine_recurrence_closed_form", True, []),
    (record(UP, [item(200, "a[@v] = a[@v-1]+@n", "a[@v]", "a[@v-1]")]), "prefix_or_neighbor_dependency", False, []),
    (record(HEAD, [item(200, "a[@v] = a[@v*2]", "a[@v]", "a[@v*2]")]), "dependency_or_inplace_update", False, []),
    (record(HEAD, [item(300, "b[0] = x", "b[0]"), own(150, "x = 1"), item(500, "total += x")], inner=[(200, 400, IN, "ForStmt")]), "hybrid_elementwise_store", True, ["store_map"]),
    (record(HEAD, [item(250, "total += @n")], controls=[(300, "ContinueStmt")], inner=[(200, 400, IN, "ForStmt")]), "hybrid_elementwise_reduction", True, ["scalar_reduction"]),
    (record(HEAD, [item(200, "h[b[@v]] += 1", "h[b[@v]]", "b[@v]")]), "conflict_update", False, []),
    (record(HEAD, [item(200, "a[0] += b[@v]", "a[0]", "b[@v]")]), "nested_reduction_update", True, []),
    (record(HEAD, [item(300, "a[@v] += b[k]", "a[@v]", "b[k]")], inner=[(200, 400, IN, "ForStmt")]), "nested_reduction_update", False, ["nested_reduction_update"]),
    (record(HEAD, [item(200, "a[@v] *= b[@v]", "a[@v]", "b[@v]")]), "array_update", True, []),
    (record(HEAD, [own(150, "s = 0"), item(180, "s += b[@v]", "", "b[@v]"), item(200, "a[@v] = s", "a[@v]")]), "prefix_or_rolling_output", True, []),
    (record(HEAD, [item(200, "s += b[@v]", "", "b[@v]")]), "scalar_reduction", True, []),
    (record(HEAD, [item(200, "total = total*b[@v]", "", "b[@v]")]), "scalar_reduction", True, []),
    (record(HEAD, [item(200, "other = b[@v]", "", "b[@v]"), item(300, "v.x = 1")]), "pseudocode_loop", False, []),
    (record(HEAD, [STORE], branches=[(190, 300, "b[@v] > @n")]), "predicate_store_map", True, []),
    (record(HEAD, [item(200, "a[@v] = c[b[@v]]", "a[@v]", "c[b[@v]]")]), "indexed_gather_scatter_map", True, []),
    (record(HEAD, [item(200, "a[b[@v]] = c", "a[b[@v]]")]), "indexed_gather_scatter_map", True, []),
    (record(HEAD, [item(120, "@v = 0", initializer=True), STORE]), "store_map", True, []),
    (record("for (int @v = 0; @v < @v + n; ++@v)", [STORE]), "store_map", False, []),
    (record(HEAD, [item(200, "*q++ = *p++", "q[0]")]), "store_map", False, []),
    (record(HEAD, [item(200, "a[@v] = {1, x}", "a[@v]")]), "store_map", False, []),
    (record(HEAD, [STORE], snippet="for (...) { memcpy(a, b, n); }"), "store_map", False, []),
    (record("for (;;)", []), "pseudocode_loop", False, []),
]
WHICH = f"p_partkey % {len(RECORDS)}"
CHOSEN = "replace(replace(CASE " + " ".join("WHEN {} = {} THEN '{}'".format(WHICH, k, r.replace("'", "''")) for k, (r, *_) in enumerate(RECORDS)) + " END, '@v', CASE WHEN p_size % 2 = 0 THEN 'i' ELSE 'row' END), '@n', cast(p_size AS string))"
ALL_KINDS = [(k, nth, kind) for k, (_, mine, _, below) in enumerate(RECORDS) for nth, kind in enumerate([mine, *below])]
D_WANTED = "(VALUES " + ", ".join(f"({k}, {nth}, '{kind}')" for k, nth, kind in ALL_KINDS) + ") w(k, nth, kind)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part")).selectExpr("p_partkey AS id", f"{CHOSEN} AS j")
    return rows.select("id", F.from_json("j", loops.RECORD).alias("r")).select("id", "r.*")


def flags_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.loop_flags(records(spark, sf_dir), "id")


@query(f"SELECT p_partkey AS id, nth, kind FROM part JOIN {D_WANTED} ON {WHICH} = k")
def q134_loop_kinds(spark, sf_dir):
    """The kind of every loop of every record, from flags that its items, branches and inner loops give."""
    return flags_of(spark, sf_dir).select("id", "nth", regions.region_kind().alias("kind"))


def kinds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, nth, begin, end, kind, vector) of every loop; none of these steps through tasks or base pointers, or repeats one update."""
    absent = {k: F.lit(False) for k in ("scheduler", "pointer_scheduler", "invariant_update")}
    flags = flags_of(spark, sf_dir).withColumn("kind", regions.region_kind()).withColumns(absent)
    return flags.select("id", "nth", "begin", "end", "kind", regions.runs_as_vector().alias("vector"))


@query("SELECT p_partkey AS id, vector FROM part JOIN (VALUES " + ", ".join(f"({k}, {vector})" for k, (_, _, vector, _) in enumerate(RECORDS)) + f") w(k, vector) ON {WHICH} = k")
def q135_vector_loops(spark, sf_dir):
    """Whether the outermost loop of every record runs as a vector loop."""
    return kinds_of(spark, sf_dir).where("nth = 0").select("id", "vector")


#: Labels of each record's items, in their order, by hand.
LABELLED = [
    "write write reduce reduce", "write update update", "update", "init reduce write", "write", "write", "write", "scan write", "update write", "reduce", "scan", "reduce", "compute", "update write", "init compute write", "compute",
    "update", "compute", "compute", "arg_reduce", "reduce", "state_reduce", "compute", "write", "write write", "write", "write", "write init reduce", "reduce", "conflict_update", "reduce", "reduce", "lane_update",
    "init scan write", "reduce", "reduce", "compute compute", "write", "write", "write", "- write", "write", "write", "write", "write", "",
]
D_LABELS = "(VALUES " + ", ".join(f"({k}, {at}, '{label.strip('-')}')" for k, labels in enumerate(LABELLED) for at, label in enumerate(labels.split())) + ") w(k, item, label)"


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The loops with their kinds, and the items with their labels."""
    kinds = materialize(kinds_of(spark, sf_dir))
    return kinds, loops.item_flags(records(spark, sf_dir), kinds, "id").withColumn("label", regions.item_label())


@query(f"SELECT p_partkey AS id, item, label FROM part JOIN {D_LABELS} ON {WHICH} = k")
def q145_loop_item_labels(spark, sf_dir):
    """The label of every item of every record, from what it does and from the loops around it."""
    return labelled(spark, sf_dir)[1].select("id", F.col("at").alias("item"), "label")


def rendered(k: int) -> str:
    """A record's text, put together by hand from the kinds and labels above."""
    r, names = json.loads(RECORDS[k][0]), [n for n in LABELLED[k].split()]
    own = [(o["begin"], o["end"], f"loop {o['header']}: {kind}") for o, kind in zip(r["loops"], [RECORDS[k][1], *RECORDS[k][3]], strict=True)]
    things = [(b, e, head, True) for b, e, head in own] + [(i["begin"], i["begin"], f"{label}: {i['lhs']} {i['op']} {i['rhs']}", False) for i, label in zip(r["items"], names, strict=True) if label != "-"]

    def inside(lo: int, hi: int, step: str) -> list[str]:
        out, at = [], lo
        for b, e, head, loop in sorted(things):
            if at <= b <= hi and (b, e) != (lo, hi):
                out += [f"{step}{head} {{", *inside(b, e, step + "  "), f"{step}}}"] if loop else [step + head]
                at = e + 1 if loop else at
        return out

    return "\n".join(inside(0, 10_000, ""))


D_RENDERED = "(VALUES " + ", ".join("({}, '{}')".format(k, rendered(k).replace("'", "''")) for k in range(len(RECORDS))) + ") w(k, t)"


@query(f"SELECT p_partkey AS id, replace(replace(t, '@v', CASE WHEN p_size % 2 = 0 THEN 'i' ELSE 'row' END), '@n', cast(p_size AS string)) AS text FROM part JOIN {D_RENDERED} ON {WHICH} = k")
def q146_rendered_regions(spark, sf_dir):
    """Every record as nested text: loops with their kinds, and in them, in order, the labelled items and the inner loops."""
    kinds, items = labelled(spark, sf_dir)
    name = lambda of, n: F.concat(F.lit(of), F.col(n).cast("string"))
    heads = records(spark, sf_dir).select("id", F.posexplode("loops").alias("nth", "l")).select("id", "nth", F.col("l.header").alias("header"))
    outer = kinds.select("id", F.col("nth").alias("above"), F.col("begin").alias("b"), F.col("end").alias("e"))
    around = kinds.join(outer, "id").where("b <= begin AND end <= e AND above <> nth").groupBy("id", "nth").agg(F.min(F.struct(F.col("e") - F.col("b"), "above"))["above"].alias("above"))
    rows = kinds.join(heads, ["id", "nth"]).join(around, ["id", "nth"], "left").select(F.col("id").alias("tree"), name("loop", "nth").alias("id"), name("loop", "above").alias("parent"), F.col("begin").alias("place"), F.concat(F.lit("loop "), "header", F.lit(": "), "kind", F.lit(" {")).alias("head"), F.lit("}").alias("tail"))
    lines = items.where("label <> ''").select(F.col("id").alias("tree"), name("item", "at").alias("id"), name("loop", "nth").alias("parent"), F.col("begin").alias("place"), F.concat("label", F.lit(": "), "line").alias("head"), F.lit(None).cast("string").alias("tail"))
    return nesting.assembled(rows.unionByName(lines), "tree", "id", "parent", "place", "head", "tail").select(F.col("tree").alias("id"), "text")
