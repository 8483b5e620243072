"""What a loop does, from the record of its function: flags that the region ladders ask for.

A record has arrays of loops, items (assignments and declarations with the elements
that they write and read), branches, controls, returns and calls, each with the places
where it begins (and ends) in the text. "In this loop", "directly in it" and "under
this branch" are range tests on those places. Names that a loop assigns from
themselves are its states; states that it does not declare itself are carried from
one turn to the next, and where they are used later decides the flags.
"""

from __future__ import annotations

from functools import reduce as fold
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.syntax import CONTAINER, loop_spec
from corvid.functions.text import barrier

REF = "array<struct<base:string,index:string>>"
#: The JSON of a function's record.
RECORD = (
    "loops array<struct<begin:int,end:int,kind:string,header:string,snippet:string>>, "
    f"items array<struct<begin:int,lhs:string,op:string,rhs:string,declared:boolean,initializer:boolean,writes:{REF},reads:{REF}>>, "
    "branches array<struct<begin:int,end:int,cond:string>>, controls array<struct<begin:int,kind:string>>, returns array<struct<begin:int>>, calls array<struct<begin:int,name:string>>, types map<string,string>"
)

# Calls with effects beyond their result, what makes a loop irregular, names that gather, constants that set a state, and updates in a condition.
EFFECTS = ("memset", "memcpy", "memmove", "bzero", "resize", "clear", "push_back", "sort", "stable_sort", "qsort")
IRREGULAR = r"\bstd::(?:to_string|string)\b|\.rbegin\s*\(|\.rend\s*\(|\.length\s*\(|\.substr\s*\(|\.push_back\s*\(|\.erase\s*\(|\.insert\s*\(|\bfind\s*\([^;\n]*\.begin\s*\(|\bmem(?:cpy|move)\s*\("
GATHERS = r"(?i)sum|count|cnt|num|res|total|acc|dot|norm|mean|var|minv|maxv|^(?:ans|answer|min|max)(?:_|$|\d)"
CONSTANTS = ("0", "1", "true", "false", "-1")
INDEX_NAME = r"(?i)(?:^|_)(idx|index|pos|arg|max_i|min_i)(?:_|$)"
STRINGS = r"\b(?:std::)?(?:string|string_view)\b"
STEPPED = r"(?:\+\+|--)\s*[A-Za-z_]|[A-Za-z0-9_]\s*(?:\+\+|--)"
ASSIGNED = r"[A-Za-z0-9_]\s*(?:[-+*/%&|^]=|(?<![!<>=])=(?!=))"
POINTER_STEP = r"\*\s*[A-Za-z_]\w*\s*\+\+"
NAME = r"^[A-Za-z_]\w*$"


def says(text: Column, name: Column) -> Column:
    """Whether a text has a name as a word."""
    return F.rlike(text, F.concat(F.lit(r"\b"), name, F.lit(r"\b")))


def like(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def none(xs: Column) -> Column:
    return F.coalesce(F.size(xs), F.lit(0)) < 1


def text(c: Column) -> Column:
    """Blanks squeezed; null: empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def whole(i: Column) -> Column:
    """An item without nulls."""
    return F.struct(
        i["begin"].alias("begin"), text(i["lhs"]).alias("lhs"), text(i["rhs"]).alias("rhs"), F.coalesce(i["op"], F.lit("=")).alias("op"), F.coalesce(i["declared"], F.lit(False)).alias("declared"), F.coalesce(i["initializer"], F.lit(False)).alias("initializer"),
        F.coalesce(i["writes"], F.array()).alias("writes"), F.coalesce(i["reads"], F.array()).alias("reads"),
    )


# What an item is by itself.


def writes(i: Column) -> Column:
    return ~none(i["writes"])


def scalar(i: Column) -> Column:
    return none(i["writes"]) & like(i["lhs"], NAME)


def from_itself(i: Column) -> Column:
    """Whether a name gets its new value from its old one."""
    return scalar(i) & ~i["declared"] & ((i["op"] != "=") | says(i["rhs"], i["lhs"]))


def reduces(i: Column) -> Column:
    return scalar(i) & ((i["op"] != "=") | (like(i["lhs"], GATHERS) & says(i["rhs"], i["lhs"])))


def updates(i: Column) -> Column:
    return scalar(i) & ~i["declared"] & ((i["op"] != "=") | says(i["rhs"], i["lhs"]) | i["rhs"].isin(*CONSTANTS))


def gathers(i: Column) -> Column:
    """Whether elements that an item reads go into the name that it updates."""
    return reduces(i) & ~none(i["reads"]) & (i["op"].isin("+=", "-=", "*=", "&=", "|=", "^=") | ((i["op"] == "=") & says(i["rhs"], i["lhs"])))


def numbered(i: Column) -> Column:
    return like(i["lhs"], INDEX_NAME) & ~i["rhs"].isin("true", "false")


def truth(i: Column) -> Column:
    return i["rhs"].isin("true", "false")


def loop_flags(functions: DataFrame, id: str) -> DataFrame:
    """(id, nth, begin, end, and a boolean for each flag of the ladders) for each loop of each function, nth from 0; a null array counts as empty, a null text as an empty one."""
    arrays = ("loops", "items", "branches", "controls", "returns", "calls")
    rows = functions.select(id, *(F.coalesce(c, F.array()).alias(c) for c in arrays), "types")
    rows = rows.select(*rows.columns, F.posexplode("loops").alias("nth", "loop"))
    loop, col = F.col("loop"), F.col
    over = lambda outer, x: (outer["begin"] <= x["begin"]) & (x["begin"] <= outer["end"])
    here = lambda x: over(loop, x)
    some = lambda xs, f: F.coalesce(F.exists(xs, lambda x: F.coalesce(f(x), F.lit(False))), F.lit(False))
    match = lambda *xs: fold(and_, xs)

    # First the parts of a loop, each worked out once.
    others = F.filter("loops", lambda o: here(o) & ~((o["begin"] == loop["begin"]) & (o["end"] == loop["end"])))
    tidy = F.transform(F.filter("items", here), whole)
    rows = barrier(rows.withColumn("in", F.struct(others.alias("inner"), F.filter(tidy, lambda i: ~i["initializer"]).alias("items"), loop_spec(text(loop["header"])).alias("spec"), text(loop["header"]).alias("header"))), "in")
    inner, items, spec, header = (col("in")[k] for k in ("inner", "items", "spec", "header"))
    direct_inner = F.filter(inner, lambda c: ~some(inner, lambda o: over(o, c) & (o["end"] - o["begin"] > c["end"] - c["begin"])))
    direct = F.filter(items, lambda i: ~some(inner, lambda o: over(o, i)))
    direct_branches = F.filter("branches", lambda b: here(b) & ~some(inner, lambda o: over(o, b)))
    names = lambda xs, f: F.array_distinct(F.transform(F.filter(xs, f), lambda i: i["lhs"]))
    states, locals_, assigned = names(items, from_itself), names(items, lambda i: i["declared"] & scalar(i)), names(items, lambda i: scalar(i) & ~i["declared"])
    rows = barrier(rows.withColumn("of", F.struct(direct_inner.alias("inner"), direct.alias("items"), direct_branches.alias("branches"), states.alias("states"), locals_.alias("locals"), F.array_except(states, locals_).alias("carried"), F.array_except(assigned, locals_).alias("assigned"))), "of")
    own = col("of")
    branches, carried = own["branches"], own["carried"]
    counted = spec.isNotNull() & ~says(spec["end"], spec["var"])
    var = spec["var"]
    indexed = lambda refs: some(refs, lambda r: says(r["index"], var))
    indirect = lambda refs: some(refs, lambda r: like(r["index"], r"\b[A-Za-z_]\w*\s*\["))
    conditions = lambda names: some(branches, lambda b: some(names, lambda n: says(text(b["cond"]), n)))
    returns_in = lambda b: some(col("returns"), lambda r: over(b, r))
    jumps = lambda x: x["kind"].isin("BreakStmt", "ContinueStmt")
    irregular = like(F.lower(F.coalesce(loop["snippet"], F.lit(""))), IRREGULAR)
    side_call = some(col("calls"), lambda c: here(c) & F.element_at(F.split(c["name"], "::"), -1).isin(*EFFECTS))
    stream = some(items, lambda i: like(i["rhs"], POINTER_STEP)) & some(items, lambda i: like(i["lhs"], POINTER_STEP))
    # An element that is written where another one of its array is read.
    flat = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\b(size_t|int|long|uint32_t|uint64_t|std::size_t)\s*\(([^)]*)\)", "$2"), r"\(([^()]+)\)", "$1"), r"\s+", "")
    pairs = F.flatten(F.transform(items, lambda i: F.flatten(F.transform(i["writes"], lambda w: F.transform(F.filter(i["reads"], lambda r: (r["base"] == w["base"]) & (flat(r["index"]) != flat(w["index"]))), lambda r: F.concat(flat(w["index"]), flat(r["index"])))))))
    element = lambda i: F.get(i["writes"], 0)
    recurs = lambda i: match(F.size(i["writes"]) == 1, i["op"] == "=", text(element(i)["index"]) == var, F.rlike(i["rhs"], F.concat(F.lit(r"\b"), element(i)["base"], F.lit(r"\s*\[\s*"), var, F.lit(r"\s*-\s*1\s*\]\s*[+-]\s*(?:[-+]?\d+|[A-Za-z_]\w*)"))))
    before = F.when(like(spec["start"], r"^\d+$"), (spec["start"].try_cast("int") - 1).cast("string")).otherwise(F.concat(spec["start"], F.lit("-1")))
    seeded = lambda i: some(col("items"), lambda s: (s["begin"] < loop["begin"]) & some(s["writes"], lambda w: (w["base"] == element(i)["base"]) & (flat(w["index"]) == flat(before))))
    # An inner loop whose own state is in its head, or that gathers while it counts.
    of = lambda c: F.filter(items, lambda i: over(c, i))
    inner_spec = lambda c: loop_spec(text(c["header"])).isNotNull()
    inner_states = lambda c: names(of(c), lambda i: from_itself(i) | (i["declared"] & scalar(i)))
    inner_while = lambda c: F.startswith(F.lower(text(c["header"])), F.lit("while")) | c["kind"].isin("WhileStmt", "DoStmt")
    lane_local = lambda c: match(inner_while(c) | inner_spec(c), ~some(col("calls"), lambda x: over(c, x) & F.element_at(F.split(x["name"], "::"), -1).isin(*EFFECTS)), ~some(of(c), writes), ~some(col("controls"), lambda x: over(c, x) & jumps(x)), some(inner_states(c), lambda n: says(text(c["header"]), n)) | (inner_spec(c) & some(of(c), reduces)))
    is_container = lambda name: like(F.coalesce(F.try_element_at("types", name), F.lit("")), CONTAINER)
    picks = lambda i: match(scalar(i), ~i["declared"], i["op"] == "=", i["rhs"] != "", i["rhs"] != i["lhs"], ~is_container(i["lhs"]), ~like(i["rhs"], r"\b(?:std::)?(?:vector|string|map|unordered_map|set|unordered_set)\b"), ~none(i["reads"]) | like(i["rhs"], NAME))
    packs = lambda i: match(scalar(i), ~i["declared"], i["op"] == "=", is_container(i["lhs"]), like(i["rhs"], r"^\{.*\b[A-Za-z_]\w*\b.*\}$"))
    under = lambda i: some(branches, lambda b: over(b, i))
    written = F.filter(own["items"], writes)
    plainly = ~some(written, lambda i: (i["op"] != "=") | indirect(i["writes"]))
    calm = match(counted, ~none(own["inner"]), ~irregular, ~side_call, ~stream, none(pairs), some(written, lambda i: indexed(i["writes"])), plainly)
    predicate_return = counted & some(branches, returns_in)
    mentioned = lambda name: some(branches, lambda b: says(text(b["cond"]), name))
    threshold = lambda n: some(branches, lambda b: returns_in(b) & says(text(b["cond"]), n))
    stepped = lambda n: some(items, lambda i: (i["lhs"] == n) & i["op"].isin("+=", "-=") & some(branches, lambda b: over(b, i) & like(text(b["cond"]), r"[A-Za-z_]\w*\s*\[")))
    swapped = F.filter(items, writes)
    bases = F.array_distinct(F.flatten(F.transform(swapped, lambda i: F.transform(i["writes"], lambda w: w["base"]))))
    moves = lambda op: some(items, lambda i: scalar(i) & (i["op"] == op))
    chosen = lambda f: some(items, lambda i: (picks(i) | packs(i)) & under(i) & f(i))
    compound = lambda i: writes(i) & (i["op"] != "=")
    flags = {
        "while_header": F.startswith(F.lower(header), F.lit("while")),
        "while_kind": loop["kind"].isin("WhileStmt", "DoStmt"),
        "two_pointer": match(like(header, r"^while\s*\(\s*[A-Za-z_]\w*\s*<\s*[A-Za-z_]\w*\s*\)\s*$"), F.size(swapped) >= 2, F.size(bases) == 1, moves("+="), moves("-=")),
        "child": ~none(inner), "branch": ~none(branches), "spec": counted, "irregular": irregular, "side_call": side_call,
        "outer_local": match(calm, some(own["inner"], lambda c: says(text(c["header"]), var)), F.arrays_overlap(own["locals"], own["states"])),
        "branch_control": some(col("controls"), lambda x: jumps(x) & here(x) & some(branches, lambda b: over(b, x))),
        "condition_update": some(branches, lambda b: like(text(b["cond"]), STEPPED) | like(text(b["cond"]), ASSIGNED)),
        "carried_output": some(items, lambda i: writes(i) & some(carried, lambda n: says(i["rhs"], n))),
        "prefix_scan": match(~none(branches), predicate_return, (~some(items, writes) & some(carried, lambda n: threshold(n) & stepped(n))) | (~irregular & some(items, lambda i: gathers(i) & mentioned(i["lhs"])))),
        "local_child": some(inner, lane_local),
        "array_write": some(items, writes), "reduction": some(items, reduces),
        "state_control": conditions(own["assigned"]), "condition_state": conditions(carried),
        "state_update": some(items, updates), "compound_scalar": some(items, lambda i: scalar(i) & (i["op"] != "=")),
        "branch_inside": some(col("branches"), here), "controls": some(col("controls"), here),
        "per_element": match(calm, some(own["items"], lambda i: indexed(i["reads"])), ~some(items, lambda i: compound(i) | (writes(i) & ~indexed(i["writes"]))), ~some(col("controls"), lambda x: jumps(x) & here(x)), ~some(col("returns"), here), ~none(own["states"]), none(carried), some(col("branches"), here)),
        "predicate_return": predicate_return,
        "string_condition": some(branches, lambda b: some(F.regexp_extract_all(text(b["cond"]), F.lit(r"([A-Za-z_]\w*)\s*\["), F.lit(1)), lambda n: like(F.coalesce(F.try_element_at("types", n), F.lit("")), STRINGS))),
        "selection": chosen(lambda i: F.lit(True)), "selection_index": chosen(lambda i: numbered(i) | truth(i) | packs(i)),
        "return_inside": some(col("returns"), here),
        "dependency": ~none(pairs), "near_index": some(pairs, lambda p: like(p, r"\+1|-1")), "closed_form": counted & some(items, lambda i: recurs(i) & seeded(i)),
        "local_scalar": ~none(own["locals"]), "indirect_compound": some(items, lambda i: compound(i) & indirect(i["writes"])), "array_compound": some(items, compound),
        "fixed_index": counted & some(items, lambda i: compound(i) & ~indexed(i["writes"])), "two_loops": ~none(inner),
        "indirect": some(items, lambda i: indirect(i["writes"]) | indirect(i["reads"])),
        "aggregate_container": some(items, lambda i: (writes(i) & like(i["rhs"], r"^\{.*\}$")) | (like(i["lhs"], r"\]\s*\[") & (i["op"] != "="))),
        "pointer_stream": stream,
    }
    return rows.select(id, "nth", loop["begin"].alias("begin"), loop["end"].alias("end"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))


#: Fixed value: numbers, constants and names that make an initial value plain.
PLAIN = r"^(?:[-+]?(?:0x[0-9A-Fa-f]+|\d+(?:\.\d+)?)[uUlLfF]*|true|false|NULL|nullptr|\"\"|\{\s*\}|[A-Za-z_]\w*)?$"


def item_flags(functions: DataFrame, regions: DataFrame, id: str) -> DataFrame:
    """(id, nth, at, kind, op, line, and a boolean for each flag of the label ladder): the items of each function with the innermost loop that holds them, nth null outside of loops.

    `regions` has (id, nth, begin, end, kind, vector) of each loop. An item is
    `reducing` if its loop or one around it runs as a vector loop, and `local` if
    an item of its loop or of one below declares its name.
    """
    held = F.sort_array(F.collect_list(F.struct(F.col("end") - F.col("begin"), "nth", "begin", "end", "kind", "vector")))
    rows = functions.select(id, F.transform(F.coalesce("items", F.array()), whole).alias("items")).join(regions.groupBy(id).agg(held.alias("loops")), id, "left")
    rows = barrier(rows.withColumn("loops", F.coalesce("loops", F.array())).select(id, "items", "loops", F.posexplode("items").alias("at", "item")), "item")
    i = F.col("item")
    around = F.filter("loops", lambda o: (o["begin"] <= i["begin"]) & (i["begin"] <= o["end"]))
    rows = rows.withColumn("around", around).withColumn("loop", F.get("around", 0))
    loop = F.col("loop")
    inside = lambda x: (loop["begin"] <= x["begin"]) & (x["begin"] <= loop["end"])
    lower = lambda x: F.exists("loops", lambda o: (o["nth"] != loop["nth"]) & (loop["begin"] <= o["begin"]) & (o["end"] <= loop["end"]) & (o["begin"] <= x["begin"]) & (x["begin"] <= o["end"]))
    declares = lambda deep: F.coalesce(F.exists("items", lambda x: x["declared"] & none(x["writes"]) & ~x["initializer"] & (x["lhs"] == i["lhs"]) & inside(x) & (F.lit(True) if deep else ~lower(x))), F.lit(False))
    vector = F.coalesce(loop["vector"], F.lit(False))
    flags = {
        "initializer": i["initializer"], "declaration": i["declared"], "plain_init": i["declared"] & none(i["writes"]) & none(i["reads"]) & (i["op"] == "=") & like(i["lhs"], NAME) & like(i["rhs"], PLAIN),
        "prefix_update": gathers(i), "vector": vector, "direct_local": declares(False), "scalar_lhs": scalar(i), "reducing": F.exists("around", lambda o: o["vector"]), "local": declares(True),
        "boolean_state": truth(i), "arg_index": numbered(i), "state_update": updates(i), "scalar_reduction": reduces(i), "writes": writes(i), "reads": ~none(i["reads"]),
    }
    return rows.select(id, loop["nth"].alias("nth"), "at", i["begin"].alias("begin"), F.coalesce(loop["kind"], F.lit("")).alias("kind"), i["op"].alias("op"), F.concat_ws(" ", i["lhs"], i["op"], i["rhs"]).alias("line"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))
