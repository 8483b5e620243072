"""Features of syntax trees that a parser has dumped as JSON: {"type", "named", "text", "field", "children"}, `named` true by default.

A tree is a flat array of nodes, parents first, each with its depth and the
size of its subtree. So a node's place and size say what it holds: "inside",
"left side of" and "innermost loop of" are range tests on the array. A node
opens where it stands and closes after its last descendant; in the tree's events
(openings and closings in order) a subtree is one slice, and so its canonical
text is a slice joined.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from corvid.functions.code import ASSIGN, MATH, let
from corvid.functions.text import barrier

# Operators and brackets that a canonical text keeps, and kinds of nodes.
OPERATORS = ("+", "-", "*", "/", "%", "<<", ">>", "&", "|", "^", "&&", "||", "==", "!=", "<", ">", "<=", ">=", *ASSIGN, "!", "~", "?", ":")
BRACKETS = ("[", "]", "(", ")", "{", "}", ",", ";")
NAMES = ("identifier", "field_identifier", "namespace_identifier")
NUMBERS = ("number_literal", "char_literal")
STRINGS = ("string_literal", "raw_string_literal")
LOOPS = ("for_statement", "while_statement", "do_statement")
EXPRESSIONS = ("binary_expression", "unary_expression", "call_expression", "subscript_expression", "conditional_expression")
#: Lists of features and how many of each are kept at most.
LISTS = {"loop_nest": 40, "array_access": 40, "assignment_tree": 40, "expression_tree": 40, "call_graph": 40, "returns": 20, "conditions": 30, "writes": 30, "reads": 30, "types": 40}
DIGESTS = ("typed_ast", "untyped_ast", "loop_nest", "array_access", "assignment_tree", "expression_tree", "call_graph", "composite")

NODE = StructType([
    StructField("depth", IntegerType()), StructField("size", IntegerType()), StructField("kind", StringType()), StructField("named", BooleanType()),
    StructField("text", StringType()), StructField("field", StringType()), StructField("under", IntegerType()),
])


def is_leaf(kind: str, named: bool) -> bool:
    """Whether a canonical text says what a node is in one word, and nothing of what is below it."""
    return not named or kind in NAMES + NUMBERS + STRINGS or "type" in kind


@F.arrow_udf(ArrayType(NODE))
def parsed_nodes(texts: pa.Array) -> pa.Array:
    """All nodes of a dumped tree, parents first, each with its depth and the number of nodes in its subtree; null where the text is no JSON object.

    `under` is the place of the innermost node above that is a leaf of canonical texts, -1 for none:
    in the text of a subtree that holds that leaf the node is hidden.
    """
    # The nodes of all trees, a list for each field.
    depths, sizes, kinds, names, words, fields, unders = held = [[] for _ in NODE.fields]

    def flat(root):
        first, open = len(depths), []
        todo = [(0, root, -1)]
        while todo:
            depth, node, under = todo.pop()
            at = len(depths)
            while len(open) > depth:
                begun = open.pop()
                sizes[begun] = at - begun
            open.append(at)
            kind, named, field = str(node.get("type") or ""), node.get("named") is not False, node.get("field")
            for values, value in zip(held, (depth, 0, kind, named, str(node.get("text") or ""), field, under), strict=True):
                values.append(value)
            below = at - first if is_leaf(kind, named) else under
            todo += [(depth + 1, c, below) for c in reversed(node.get("children") or []) if isinstance(c, dict)]
        for begun in open:
            sizes[begun] = len(depths) - begun

    # A null offset is a null list, which ends where the next one begins.
    offsets = []
    for text in texts.to_pylist():
        try:
            tree = json.loads(text or "")
        except ValueError:
            tree = None
        offsets.append(len(depths) if isinstance(tree, dict) else None)
        if isinstance(tree, dict):
            flat(tree)
    kinds_of = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32())
    nodes = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(held, kinds_of, strict=True)], NODE.names)
    return pa.ListArray.from_arrays(pa.array([*offsets, len(depths)], pa.int32()), nodes)


# A node without children, as a dump writes it without blanks: a quote inside a JSON string has a backslash before it, so what looks like one is one.
SHOWN = r'[^"\\\x00-\x1f]*'
hidden = lambda kinds, field: r'(\{"type":"(?:' + "|".join(kinds) + r')"(?:,"field":"' + field + SHOWN + r'")?,"text":")' + SHOWN + r'("\})'


def shape_text(text: Column) -> Column:
    """A dumped tree without texts that no feature shows: those of numbers and strings, and of names that nothing calls. Trees of one shape have the same features.

    Names stay wherever something but a plain identifier is called, or a text has an escape.
    """
    others = F.rlike(text, F.lit(r'(?<!\{"type":"identifier","field":)"function"|"function"(?!,"text":"' + SHOWN + r'"\})'))
    names = F.regexp_replace(text, hidden((*NAMES, *NUMBERS, *STRINGS), '(?!function")'), "$1$2")
    return F.when(F.contains(text, F.lit("\\")) | others, F.regexp_replace(text, hidden((*NUMBERS, *STRINGS), ""), "$1$2")).otherwise(names)


#: Rows of one shape that are kept together at most, about.
TOGETHER = 1 << 20


def shape_groups(rows: DataFrame, id: str, shapes: list[Column], sources: list[str], count: int) -> DataFrame:
    """(ids, sources of the first id): rows of equal shapes, whose texts need be read once only.

    `count` is the number of rows: large tables are dealt over pieces by id, so that no group's list of ids grows with them.
    """
    piece = F.pmod(F.xxhash64(id), F.lit(-(-count // TOGETHER) or 1))
    digests = {f"shape{k}": F.sha2(F.encode(s, "UTF-8"), 256) for k, s in enumerate(shapes)}
    keyed = rows.select(id, F.struct(*sources).alias("source"), piece.alias("piece"), *(d.alias(k) for k, d in digests.items()))
    return keyed.groupBy("piece", *digests).agg(F.sort_array(F.collect_list(id)).alias("ids"), F.min_by("source", id).alias("source")).select("ids", "source.*")


def word(n: Column) -> Column:
    """What a leaf is in a canonical text; null for an inner node."""
    kind = n["kind"]
    return F.when(kind.isin(*NAMES), "ID").when(kind.isin(*NUMBERS), "NUM").when(kind.isin(*STRINGS), "STR").when(F.contains(kind, F.lit("type")), "TYPE")


def events(nodes: Column) -> Column:
    """Openings and closings of all nodes (with their `word`) in order, each struct(at, order, deep, under, and a text for each of four kinds).

    `typed` and `untyped` are token lists: kinds with closing tags, leaves by what they are,
    operators and brackets as they stand. `plain` and `names` are bracketed expressions:
    (kind part part), leaves by what they are, operators as they stand; `names` keeps names.
    """

    def two(n, i):
        put = lambda at, order, deep, *texts: F.struct(at.alias("at"), F.lit(order).alias("order"), deep.alias("deep"), n["under"].alias("under"), *(t.alias(k) for k, t in zip(("typed", "untyped", "plain", "names"), texts, strict=True)))
        text = F.regexp_replace(n["text"], r"^\s+|\s+$", "")
        opened = lambda marks, own: F.when(~n["named"], F.when(n["text"].isin(*marks), n["text"]).otherwise("")).otherwise(own)
        closed = lambda own: F.when(~n["named"] | n["word"].isNotNull(), "").otherwise(own)
        tag, bracket, both = F.coalesce(n["word"], n["kind"]), F.coalesce(n["word"], F.concat(F.lit("("), n["kind"])), (*OPERATORS, *BRACKETS)
        opening = put(i, 1, F.lit(0), opened(both, F.when(n["word"] == "TYPE", F.concat(F.lit("TYPE:"), text)).otherwise(tag)), opened(both, tag), opened(OPERATORS, bracket), opened(OPERATORS, F.when(n["word"] == "ID", text).otherwise(bracket)))
        end, bar = closed(F.concat(F.lit("/"), n["kind"])), closed(F.lit(")"))
        return F.array(opening, put(i + n["size"], 0, -n["depth"], end, end, bar, bar))

    # Before a node opens, all that ends there closes, the deepest first.
    return F.sort_array(F.flatten(F.transform(nodes, two)))


def slice_of(ev: Column, n: Column, text: str) -> Column:
    """The events of the subtree of a node with its place `at`; before it stand the openings of all earlier nodes and the closings of all but its ancestors."""
    shown = F.filter(F.slice(ev, 2 * n["at"] - n["depth"] + 1, 2 * n["size"]), lambda x: (x[text] != "") & (x["under"] < n["at"]))
    return F.transform(shown, lambda x: x[text])


def expression(ev: Column, n: Column, text: str = "plain") -> Column:
    """A subtree's expression; empty for none. The node is worked out once, not again for each event that it is held against."""
    return let(n, lambda x: F.when(x.isNull(), "").otherwise(F.replace(F.array_join(slice_of(ev, x, text), " "), F.lit(" )"), F.lit(")"))))


def tree_features(rows: DataFrame, id: str, nodes: str) -> DataFrame:
    """(id, functions, max_loop_depth, a digest for each of DIGESTS, a list for each of LISTS) of every tree; rows of null nodes are left out.

    Features are of the functions' subtrees, or of the whole tree if it defines
    none. Digests are sha256 of the sorted features in lines, that of composite
    of loops, accesses, assignments, calls and returns together. Lists are sorted,
    distinct but for loop_nest, and capped.
    """
    placed = F.transform(nodes, lambda n, i: n.withField("at", i).withField("word", word(n)))
    t = barrier(rows.where(F.col(nodes).isNotNull()).select(id, placed.alias("n")), "n")
    n = F.col("n")
    kinds = lambda *k: F.filter(n, lambda x: x["kind"].isin(*k))
    whole = F.slice(n, 1, 1)
    t = barrier(t.select(id, "n", F.struct(events(n).alias("all"), kinds("function_definition").alias("f"), kinds(*LOOPS).alias("loops")).alias("e")), "e")
    e = F.col("e")
    plain = lambda x: expression(e["all"], x)
    # What a function holds, once for each function that holds it.
    roots = F.when(F.size(e["f"]) > 0, e["f"]).otherwise(whole)
    held = F.flatten(F.transform(roots, lambda f: F.transform(F.slice(n, f["at"] + 1, f["size"]), lambda x: x.withField("root", f["at"]))))
    t = barrier(t.select(id, "n", "e", F.struct(roots.alias("roots"), held.alias("held")).alias("h")), "h")
    h = F.col("h")
    held = h["held"]
    of = lambda *k: F.filter(held, lambda x: x["kind"].isin(*k))
    below = lambda x: F.slice(n, x["at"] + 2, x["size"] - 1)
    child = lambda x, field: F.get(F.filter(below(x), lambda c: (c["depth"] == x["depth"] + 1) & (c["field"] == field)), 0)
    loops = F.transform(of(*LOOPS), lambda x: F.concat(x["kind"], F.lit(":init="), plain(child(x, "initializer")), F.lit(":cond="), plain(child(x, "condition")), F.lit(":upd="), plain(child(x, "update"))))
    inside = lambda x: F.size(F.filter(e["loops"], lambda o: (o["at"] >= x["root"]) & (o["at"] < x["at"]) & (x["at"] < o["at"] + o["size"]))) + 1
    sign = lambda x: F.coalesce(F.get(F.filter(below(x), lambda c: (c["depth"] == x["depth"] + 1) & ~c["named"] & c["text"].isin(*ASSIGN)), 0)["text"], F.lit("="))
    sets = of("assignment_expression")
    right = lambda x: child(x, "right")
    accesses = lambda r: F.filter(F.slice(n, r["at"] + 1, r["size"]), lambda s: s["kind"] == "subscript_expression")
    read = F.flatten(F.transform(sets, lambda x: F.coalesce(F.transform(let(right(x), accesses), plain), F.array().cast("array<string>"))))
    called = F.transform(of("call_expression"), lambda x: expression(e["all"], child(x, "function"), "names"))
    math = lambda c: F.exists(F.array(*map(F.lit, MATH)), lambda m: F.contains(c, m))
    call_kind = lambda c: F.when(F.contains(c, F.lit("sv")), F.regexp_replace(c, r"(?s)_[suf](8|16|32|64).*", "_T")).when(math(c), F.concat(F.lit("math:"), c)).otherwise("call")
    types = F.filter(F.transform(F.filter(held, lambda x: F.contains(x["kind"], F.lit("type"))), lambda x: F.trim(F.regexp_replace(x["text"], r"\s+", " "))), lambda x: x != "")
    lists = {
        "typed_ast": F.flatten(F.transform(h["roots"], lambda f: slice_of(e["all"], f, "typed"))), "untyped_ast": F.flatten(F.transform(h["roots"], lambda f: slice_of(e["all"], f, "untyped"))),
        "loop_nest": F.sort_array(loops), "array_access": F.sort_array(F.transform(of("subscript_expression"), plain)),
        "assignment_tree": F.sort_array(F.transform(sets, lambda x: F.concat(plain(child(x, "left")), sign(x), plain(right(x))))), "expression_tree": F.sort_array(F.transform(of(*EXPRESSIONS), plain)),
        "call_graph": F.sort_array(F.transform(called, call_kind)), "returns": F.sort_array(F.transform(of("return_statement"), plain)),
        "conditions": F.transform(of("if_statement"), lambda x: plain(child(x, "condition"))), "writes": F.transform(sets, lambda x: plain(child(x, "left"))), "reads": read, "types": types,
    }
    t = barrier(t.select(id, F.size(e["f"]).cast("bigint").alias("functions"), F.coalesce(F.array_max(F.transform(of(*LOOPS), inside)), F.lit(0)).cast("bigint").alias("max_loop_depth"), F.struct(*(c.alias(k) for k, c in lists.items())).alias("l")), "l")
    item = F.col("l").getItem
    bars = lambda name, key: F.concat(F.lit(f"{name}:"), F.array_join(item(key), "|"))
    composite = F.concat_ws("\n", bars("loops", "loop_nest"), bars("arrays", "array_access"), bars("assign", "assignment_tree"), bars("calls", "call_graph"), bars("returns", "returns"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    kept = {k: F.slice(item(k) if k == "loop_nest" else F.sort_array(F.array_distinct(item(k))), 1, most) for k, most in LISTS.items()}
    return t.select(id, "functions", "max_loop_depth", *(digest(composite if k == "composite" else F.array_join(item(k), "\n")).alias(f"{k}_hash") for k in DIGESTS), *(c.alias(k) for k, c in kept.items()))


def digest_rows(features: DataFrame, id: str) -> DataFrame:
    """(id, component, digest): a row for each digest of each tree, but those of nothing; `id` may be a list of ids."""
    empty = F.sha2(F.lit(b""), 256)
    pairs = F.array(*(F.struct(F.lit(d).alias("component"), F.col(f"{d}_hash").alias("digest")) for d in DIGESTS))
    return features.select(id, F.explode(pairs).alias("d")).select(id, "d.*").where(F.col("digest") != empty)
