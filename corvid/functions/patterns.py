"""Semantic patterns of code: nested structures in one canonical text, with a strict key and a weaker one over a part of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions import code as c
from corvid.functions.features import labels

# Operators in the order in which they are tried, and parts of names that tell how data flows.
OPERATOR = r"\+=|-=|\*=|/=|%=|<<|>>|==|!=|<=|>=|&&|\|\||[+\-*/%&|^<>]"
FLOWS = ("svcvt", "svunpk", "svreinterpret", "svld1sb", "svld1ub", "svld1sh", "svld1uh", "svst1", "svaddv", "svlsr", "svasr")
MOST_FLOWS = 60
#: Words that facts show, and parts that show a word which holds them.
SHOWN = sorted({w for t in (*c.TYPES, *c.MATH, *c.CONTROL, "const") for w in t.split("::")})
PARTS = ("for", "while", "sv", "gather", "scatter", "(?i:product)")


def code_shape(text: Column) -> Column:
    """Code with words that no fact shows as x and numbers as 0 (but 2, which marks pairs). Codes of one shape have the same facts.

    Marks, blanks and words with other letters stay, so that comments, literals and heads begin and end where they did.
    """
    # Letters beyond ASCII count as parts of words, and so do other marks there: such words stay.
    inner = r"[A-Za-z0-9_\x80-\x{10ffff}]"
    alone = lambda first, shown, rest: f"(?=[{first}])(?<!{inner})(?!{shown}){rest}++(?!{inner})"
    words = alone("A-Za-z_", rf"(?:{'|'.join(SHOWN)})(?!{inner})|\w*(?:{'|'.join(PARTS)})", r"\w")
    return F.regexp_replace(F.regexp_replace(text, words, "x"), alone("0-9", f"2(?!{inner})", "[0-9]"), "0")


def bare_code(text: Column) -> Column:
    """Code in which comments are a blank, strings STR and characters CHR."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), "//[^\n]*", " ")
    return F.regexp_replace(F.regexp_replace(t, r'"(?:\\.|[^"\\])*"', " STR "), r"'(?:\\.|[^'\\])*'", " CHR ")


def call_shape(sig: Column) -> Column:
    """struct(arity, params (ptr_level, types), return) of a signature: type words and the number of pointer and reference marks, split at every comma."""
    whole = F.rlike(sig, F.lit(r"(?s)\(.*\)"))
    inside = F.when(whole, F.regexp_extract(sig, r"(?s)\((.*)\)", 1)).otherwise(sig)
    parts = F.filter(F.transform(F.split(inside, ","), lambda p: F.trim(p)), lambda p: (p != "") & (p != "void"))
    shapes = F.transform(parts, lambda p: F.struct(F.size(F.filter(c.code_tokens(p), lambda t: t.isin("*", "&"))).cast("bigint").alias("ptr_level"), F.filter(c.code_tokens(p), lambda t: t.isin(*c.TYPES, "const")).alias("types")))
    return F.struct(F.size(shapes).cast("bigint").alias("arity"), shapes.alias("params"), c.return_types(F.when(whole, sig).otherwise("")).alias("return"))


def occurrences(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def code_facts(bare: Column, sig: Column) -> Column:
    """What a semantic pattern takes from bare code and its signature alone; many codes have the same facts."""
    # Layouts and reductions with the names and marks that show them.
    found = lambda rules: F.filter(F.array(*(F.when(r, F.lit(k)) for k, r in sorted(rules.items()))), lambda x: x.isNotNull())
    has = lambda *parts: labels({p: F.contains(bare, F.lit(p)) for p in parts}, "") != F.array(F.lit(""))
    facts = {
        "flows": F.filter(F.array(*map(F.lit, FLOWS)), lambda f: F.contains(bare, f)), "fors": occurrences(bare, "for"), "whiles": occurrences(bare, "while"),
        "math": F.filter(F.array(*map(F.lit, sorted(c.MATH))), lambda m: F.rlike(bare, F.concat(F.lit(r"\b"), m, F.lit(r"\b")))),
        "layout": found({"interleaved_or_pair": has("svld2", "svst2") | F.rlike(bare, F.lit(r"\b2\s*\*")), "tuple_channel": has("svld3", "svst3", "svld4", "svst4"), "gather": has("gather"), "scatter": has("scatter"), "aos_or_struct": has(".", "->")}),
        "ops": F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(OPERATOR), F.lit(0)))),
        "reductions": found({"sum_or_reduce": F.rlike(bare, F.lit(r"\+=|svaddv|svmaxv|svminv")), "product": F.rlike(bare, F.lit(r"(?i)\*=|product")), "while_control": F.rlike(bare, F.lit(r"\bwhile\s*\(")), "predicate_test": has("svcntp", "svptest")}),
        "signature": call_shape(sig),
    }
    return F.struct(*(v.alias(k) for k, v in facts.items()))


def semantic_pattern(facts: Column, feature: dict[str, Column]) -> Column:
    """The pattern of a code's facts and its tree features (max_loop_depth and the lists); its fields are in the order of their names."""
    affine = F.exists(feature["array_access"], lambda a: F.contains(a, F.lit("*")) | F.contains(a, F.lit("+")))
    layout = F.array_sort(F.concat(facts["layout"], F.when(affine, F.array(F.lit("affine_index"))).otherwise(F.array().cast("array<string>"))))
    domain = F.struct(facts["fors"].alias("for_count"), F.size(feature["loop_nest"]).cast("bigint").alias("loop_count"), feature["max_loop_depth"].alias("max_depth"), facts["whiles"].alias("while_count"))
    fields = {
        "data_type_flow": F.slice(F.array_sort(F.array_distinct(F.concat(facts["flows"], feature["types"]))), 1, MOST_FLOWS),
        "loop_domain": domain,
        "math_calls": facts["math"],
        "memory_layout_class": F.when(F.size(layout) > 0, layout).otherwise(F.array(F.lit("contiguous_or_scalar"))),
        "ops": facts["ops"],
        "predicate_condition": feature["conditions"],
        "read_index_shape": feature["reads"],
        "reduction_operator": facts["reductions"],
        "signature_shape": facts["signature"],
        "write_target_shape": feature["writes"],
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def strict_key(pattern: Column) -> Column:
    """sha256 of the whole pattern in JSON: keys in order, no blanks."""
    return F.sha2(F.encode(F.to_json(pattern), "UTF-8"), 256)


def abstract_key(pattern: Column) -> Column:
    """As strict_key, of arity, loops, writes, reads, reductions, layout and operators only."""
    kept = ("loop_domain", "memory_layout_class", "ops", "read_index_shape", "reduction_operator", "write_target_shape")
    part = F.struct(pattern["signature_shape"]["arity"].alias("arity"), *(pattern[k].alias(k) for k in kept))
    return F.sha2(F.encode(F.to_json(part), "UTF-8"), 256)
