"""Classification ladders and multi-label rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# First match wins, in this order.
LADDER = (("small", "small"), ("ECONOMY", "economy"), ("ring", "ring"), ("bolt", "fastener"), ("STANDARD", "standard"), ("blue", "blue"))


def category(name: Column, ladder: tuple[tuple[str, str], ...] = LADDER, default: str = "other") -> Column:
    """The category of the first substring of the ladder that `name` contains."""
    c = F.lit(default)
    for part, value in reversed(ladder):
        c = F.when(F.contains(name, F.lit(part)), F.lit(value)).otherwise(c)
    return c


def ladder_sql(name: str, source: str, alias: str, id: str) -> str:
    whens = " ".join(f"WHEN contains({name}, '{p}') THEN '{v}'" for p, v in LADDER)
    return f"SELECT {id}, CASE {whens} ELSE 'other' END AS {alias} FROM {source}"


def labels(rules: dict[str, Column], default: str = "unclassified_structured") -> Column:
    """Every label whose rule holds, in order; the default alone if none does."""
    found = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


# Intrinsic names by the first part they contain, in this order.
INTRINSICS = (
    ("whilelt", "pred_whilelt"), ("cntp", "pred_count"), ("cnt", "int_count_or_vl"), ("ld1_gather", "gather"), ("st1_scatter", "scatter"), ("ld", "load"), ("st", "store"),
    ("addv", "reduction"), ("maxv", "reduction"), ("minv", "reduction"), ("orv", "reduction"), ("andv", "reduction"), ("cvt", "convert"), ("reinterpret", "reinterpret"), ("cmp", "compare"),
    ("sel", "select"), ("mla", "mulacc"), ("mad", "mulacc"), ("mul", "arith"), ("add", "arith"), ("sub", "arith"), ("div", "arith"), ("lsl", "shift"), ("lsr", "shift"), ("asr", "shift"),
    ("rev", "permute"), ("ext", "permute"), ("uzp", "permute"), ("zip", "permute"), ("trn", "permute"), ("unpk", "widen"), ("dup", "splat"), ("index", "index"),
)

# Classes of diagnostics with the keys that raise them, in the order of the output.
DIAGNOSTICS = {
    "syntax_closure": ("syntax_signals", "expected_tokens"),
    "unsupported_or_fake_intrinsic": ("unsupported_symbols",),
    "missing_infile_helper": ("missing_helper_symbols", "missing_index_symbols"),
    "undeclared_identifier_or_missing_include": ("undeclared_identifiers",),
    "ptr_type_mismatch": ("ptr_type_mismatch_calls",),
    "arg_type_mismatch": ("arg_type_mismatch_calls", "no_matching_calls"),
    "ambiguous_call": ("ambiguous_calls",),
    "compile_time_immediate_required": ("non_constant_immediate_args", "compile_time_immediate_args"),
    "missing_standard_include": ("missing_include_headers",),
    "missing_member_or_wrong_std_version": ("missing_members",),
    "unknown_type_name": ("unknown_type_names",),
    "redefinition": ("redefined_symbols",),
    "expression_type_mismatch": ("type_mismatch_messages",),
    "sizeless_sve_misuse": ("sizeless_type_messages",),
    "const_assignment": ("const_assignment_messages",),
    "invalid_cast": ("invalid_cast_messages",),
    "invalid_addressing": ("invalid_address_messages",),
    "invalid_cpp_construct": ("invalid_cpp_construct_messages",),
    "remote_evaluator_artifact": ("remote_evaluator_artifacts",),
}


def diagnostic_classes(diagnostics: Column) -> Column:
    """Classes of a map from diagnostic key to list: every class one of whose keys has a list that is not empty; `unclassified_structured` if there is none."""
    some = lambda key: F.coalesce(F.size(F.try_element_at(diagnostics, F.lit(key))) > 0, F.lit(False))
    return labels({name: reduce(or_, map(some, keys)) for name, keys in DIAGNOSTICS.items()})


def is_compile_failure(compile_ok: Column, reason: Column, log_tail: Column) -> Column:
    """No whole number but 0 in `compile_ok`, or compile in the reason, or a log that is not blank."""
    ok = F.coalesce(compile_ok.try_cast("int"), F.lit(0)) != 0
    return ~ok | F.contains(F.lower(F.coalesce(reason, F.lit(""))), F.lit("compile")) | (F.btrim(F.coalesce(log_tail, F.lit(""))) != "")


def primary_category(strategy: Column, needs_context: Column, unsuitable: Column) -> Column:
    """The first that holds: unsuitable, sequential, in need of context, hybrid; else pure."""
    chain = F.when(unsuitable, "not_suitable_for_single_function").when(strategy == "sequential", "sequential_holdout").when(needs_context, "requires_context_prelude")
    return chain.when(strategy == "hybrid", "hybrid_single_function").otherwise("pure_sve_single_function")


def structure_key(code: Column, most: int = 80) -> Column:
    """Counts of loops, branches, accesses and operators, and the first `most` vector intrinsics with their categories, in one line."""
    # What is counted, and how the line names it.
    n = lambda pattern: F.regexp_count(code, F.lit(pattern)).cast("string")
    has = lambda part: F.contains(code, F.lit(part)).cast("int").cast("string")
    named = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    intrinsics = F.slice(F.regexp_extract_all(code, F.lit(r"\bsv[a-zA-Z0-9_]*\b"), F.lit(0)), 1, most)
    kinds = F.transform(intrinsics, lambda x: category(x, INTRINSICS, "other_sv"))
    return F.concat_ws(
        "|",
        named("loop=f", n(r"\bfor\s*\("), ":w", n(r"\bwhile\s*\("), ":if", n(r"\bif\s*\("), ":ret", n(r"\breturn\b")),
        named("mem=sub", n(r"\[[^\]]+\]"), ":ptr", n(r"\+\s*[A-Za-z_][A-Za-z0-9_]*"), ":vec", has("std::vector"), ":str", has("std::string")),
        named("ops=mod", n("%"), ":shift", n("<<|>>"), ":tern", n(r"\?")),
        named("svseq=", F.array_join(kinds, ",")),
        named("sve=", F.array_join(intrinsics, ",")),
    )
