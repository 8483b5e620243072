"""Loop headers, declared types, and syntax trees that a compiler has dumped as JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from corvid.functions.text import compact

# Containers, floating types, and the kinds of nodes that a tree's stream keeps.
CONTAINER = r"\b(?:std::)?(?:vector|string|map|unordered_map|set|unordered_set|deque|list)\b"
FLOATING = r"\b(?:float|double|__fp16|float16_t|FLOAT16_t)\b"
KINDS = ("ArraySubscriptExpr", "BinaryOperator", "CallExpr", "CompoundAssignOperator", "CompoundStmt", "ConditionalOperator", "CXXForRangeStmt", "CXXMemberCallExpr", "DeclRefExpr", "DeclStmt", "ForStmt", "IfStmt", "ReturnStmt", "UnaryOperator", "VarDecl", "WhileStmt")
OPERATORS = ("BinaryOperator", "CompoundAssignOperator", "UnaryOperator")
CALLS = ("CallExpr", "CXXMemberCallExpr")


def loop_spec(header: Column) -> Column:
    """struct(var, start, cmp, end, extra, step) of a counting loop's head, or null.

    The head has one variable, which the condition compares first and the increment
    steps; what follows && in the condition is `extra`; a condition with || is no spec.
    A step that counts down has a minus sign.
    """
    head = r"^for\s*\(\s*(?:(?:[A-Za-z_][\w:<>]*\s+)+)?([A-Za-z_]\w*)\s*=\s*([^;,]+?)\s*;\s*\1\s*([<>]=?)\s*([^;]+?)\s*;\s*(.*?)\s*\)\s*$"
    h = compact(header)
    part = lambda k: F.regexp_extract(h, head, k)
    var, end, inc = part(1), part(4), part(5)
    first = F.trim(F.split_part(end, F.lit("&&"), F.lit(1)))
    extra = F.trim(F.substr(end, F.length(F.split_part(end, F.lit("&&"), F.lit(1))) + 3))
    moves = F.transform(F.split(inc, ","), lambda x: F.regexp_replace(x, r"\s+", ""))

    def step(move: Column) -> Column:
        added, taken = F.concat(var, F.lit("+=")), F.concat(var, F.lit("-="))
        more, less = F.concat(var, F.lit("="), var, F.lit("+")), F.concat(var, F.lit("="), var, F.lit("-"))
        rest = lambda lead: F.substr(move, F.length(lead) + 1)
        one = lambda sign: (move == F.concat(F.lit(sign), var)) | (move == F.concat(var, F.lit(sign)))
        return F.when(one("++"), "1").when(one("--"), "-1").when(F.startswith(move, added), rest(added)).when(F.startswith(move, taken), F.concat(F.lit("-"), rest(taken))).when(F.startswith(move, more), rest(more)).when(F.startswith(move, less), F.concat(F.lit("-"), rest(less)))

    steps = F.filter(F.transform(moves, step), lambda s: s.isNotNull())
    found = F.get(steps, 0)
    signed = F.when(F.startswith(part(3), F.lit(">")) & ~F.startswith(found, F.lit("-")), F.concat(F.lit("-"), found)).otherwise(found)
    spec = F.struct(var.alias("var"), part(2).alias("start"), part(3).alias("cmp"), first.alias("end"), extra.alias("extra"), signed.alias("step"))
    return F.when((var != "") & ~F.contains(end, F.lit("||")) & found.isNotNull(), spec)


def is_container(kind: Column) -> Column:
    """Whether a declared type is or holds a growing container."""
    return F.rlike(kind, F.lit(CONTAINER))


def is_floating(kind: Column) -> Column:
    """Whether a declared type is of floating numbers and no container."""
    return F.rlike(kind, F.lit(FLOATING)) & ~is_container(kind)


def is_string(kind: Column) -> Column:
    return F.rlike(kind, F.lit(r"\b(?:std::)?(?:string|string_view)\b"))


def element_type(kind: Column) -> Column:
    """The type of a vector's, an array's or a pointer's elements; empty for other containers, auto, void and bool."""
    bare = compact(F.regexp_replace(F.regexp_replace(kind, r"\b(?:__restrict__|__restrict|restrict|const|volatile)\b", ""), "&", " "))
    inner = F.regexp_extract(bare, r"\bstd::vector\s*<\s*([^<>,]+?)\s*(?:,.*)?>\s*$", 1)
    plain = compact(F.regexp_replace(F.regexp_replace(bare, r"\[[^\]]*\]", ""), r"[*\s]+$", ""))
    left_out = plain.isin("auto", "void", "bool") | is_container(plain)
    return F.when(inner != "", F.when(is_container(inner), "").otherwise(inner)).when(F.rlike(bare, F.lit(r"\bstd::vector\s*<")), "").when(is_string(bare), "char").when(left_out, "").otherwise(plain)


NODE = StructType([
    StructField("depth", IntegerType()), StructField("kind", StringType()), StructField("name", StringType()), StructField("opcode", StringType()), StructField("type", StringType()),
    StructField("ref", StringType()), StructField("ref_kind", StringType()), StructField("hidden", BooleanType()), StructField("size", IntegerType()),
])


@F.pandas_udf(ArrayType(NODE))
def tree_nodes(texts: pd.Series) -> pd.Series:
    """All nodes of a dumped tree, parents first, each with the number of nodes below it and itself; null where the text is no JSON.

    `hidden` marks what the compiler made up, or took from an included file.
    """

    def flat(root):
        out, todo = [], [(0, root)]
        above = []
        while todo:
            depth, node = todo.pop()
            while above and above[-1][0] >= depth:
                _, at = above.pop()
                out[at]["size"] = len(out) - at
            ref, loc = node.get("referencedDecl") or {}, node.get("loc") or {}
            above.append((depth, len(out)))
            out.append({"depth": depth, "kind": node.get("kind"), "name": node.get("name"), "opcode": node.get("opcode"), "type": (node.get("type") or {}).get("qualType"), "ref": ref.get("name"), "ref_kind": ref.get("kind"), "hidden": bool(node.get("isImplicit") or (loc.get("includedFrom") and not loc.get("file")))})
            todo += [(depth + 1, c) for c in reversed(node.get("inner") or []) if isinstance(c, dict)]
        for _, at in above:
            out[at]["size"] = len(out) - at
        return out

    found = []
    for text in texts:
        try:
            tree = json.loads(text or "")
        except ValueError:
            found.append(None)
            continue
        found.append(flat({"kind": None, "inner": tree} if isinstance(tree, list) else tree) if isinstance(tree, (dict, list)) else None)
    return pd.Series(found)


def functions_of(nodes: Column) -> Column:
    """struct(at, name) of the functions that are defined in a tree: those with a body, neither made up nor included."""
    spot = F.transform(nodes, lambda n, i: F.struct(i.alias("at"), n["name"].alias("name"), n["kind"].alias("kind"), n["hidden"].alias("hidden"), n["depth"].alias("depth"), n["size"].alias("size")))
    body = lambda f: F.exists(F.slice(nodes, f["at"] + 1, f["size"]), lambda c: (c["kind"] == "CompoundStmt") & (c["depth"] == f["depth"] + 1))
    kept = F.filter(spot, lambda f: f["kind"].isin("FunctionDecl", "CXXMethodDecl") & ~f["hidden"] & body(f))
    return F.transform(kept, lambda f: F.struct(f["at"].alias("at"), f["name"].alias("name"), f["size"].alias("size")))


def target_function(functions: Column, name: Column) -> Column:
    """The first function of that name, else the last but main, else the last; null without one."""
    named = F.filter(functions, lambda f: f["name"] == name)
    others = F.filter(functions, lambda f: ~f["name"].eqNullSafe(F.lit("main")))
    return F.coalesce(F.get(named, 0), F.try_element_at(others, F.lit(-1)), F.try_element_at(functions, F.lit(-1)))


def kind_stream(nodes: Column) -> Column:
    """The kinds of a function's nodes that matter, with operators, calls, references' kinds and variables' types."""
    kept = F.filter(nodes, lambda n: n["kind"].isin(*KINDS))
    tail = lambda n: F.when(n["kind"].isin(*OPERATORS), n["opcode"]).when(n["kind"].isin(*CALLS), F.lit("CALL")).when(n["kind"] == "DeclRefExpr", F.coalesce(n["ref_kind"], F.lit("ref"))).when(n["kind"] == "VarDecl", F.coalesce(n["type"], F.lit("var")))
    return F.array_join(F.transform(kept, lambda n: F.concat_ws(":", n["kind"], tail(n))), ",")


def tree_signature(nodes: Column) -> Column:
    """Return type and parameter types of the function whose nodes these are."""
    params = F.filter(nodes, lambda n: (n["kind"] == "ParmVarDecl") & (n["depth"] == F.get(nodes, 0)["depth"] + 1))
    return F.concat(F.lit("ret="), F.coalesce(F.get(nodes, 0)["type"], F.lit("")), F.lit("|params="), F.array_join(F.transform(params, lambda p: F.coalesce(p["type"], F.lit(""))), ","))
