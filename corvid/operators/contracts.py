"""Findings about task rows that break their contract, and totals of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import code

# The kinds of findings.
KINDS = (
    "signature_missing_from_prompt", "prompt_not_terminated_by_empty_target_signature", "bad_api_name_leaked_in_prompt", "candidate_prelude_contains_function_definition", "missing_response_contract",
    "response_contract_missing_forbidden_tokens", "harness_extern_signature_mismatch", "parent_signature_mismatch", "local_syntax_smoke_fail",
)


def contract_findings(rows: DataFrame, id: str, required: list[str], bad_names: str, helpers: dict[str, list[str]], parented: Column) -> DataFrame:
    """(id, kind, detail): a row for each kind that holds for a task; all are errors.

    `rows` has prompt, signature, prelude, contract (struct of signature_must_match_prompt
    and forbidden), extern, parent, smoke_ok, smoke_message, and a flag column for each key
    of `helpers`, whose functions a prelude may define where the flag holds and the row is
    `parented`. `required` tokens have to be forbidden; `bad_names` is a pattern of names that
    no prompt may hold. `parented` tells which rows have a parent's signature to keep to. Nulls count as
    empty or false; a task without a smoke result has failed it.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    prompt, sig, bare = text("prompt"), text("signature"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    held = F.coalesce(F.col("contract.forbidden"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), held))
    defined = code.function_names(text("prelude"))
    parented = F.coalesce(parented, F.lit(False))
    allowed = F.flatten(F.array(*(F.when(parented & F.coalesce(F.col(flag), F.lit(False)), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for flag, names in helpers.items()))) if helpers else F.array().cast("array<string>")
    differs = lambda c: (text(c) != "") & (code.signature_text(text(c)) != code.signature_text(sig))
    none = F.lit("")
    rules = (
        ((sig == "") | ~F.contains(prompt, sig), none), (~F.endswith(F.regexp_replace(prompt, r"\s+$", ""), F.concat(bare(sig), F.lit(" {\n}"))), none), (F.rlike(prompt, F.lit(bad_names)), none),
        (F.size(F.array_except(defined, allowed)) > 0, F.array_join(defined, ",")), (~F.coalesce(F.col("contract.signature_must_match_prompt"), F.lit(False)), none), (F.size(missing) > 0, F.array_join(missing, ",")),
        (differs("extern"), none), (parented & differs("parent"), text("parent")), (~F.coalesce(F.col("smoke_ok"), F.lit(False)), text("smoke_message")),
    )
    found = F.filter(F.array(*(F.when(rule, F.struct(F.lit(k).alias("kind"), detail.alias("detail"))) for k, (rule, detail) in zip(KINDS, rules, strict=True))), lambda x: x.isNotNull())
    return rows.select(id, F.inline(found))


def contract_totals(rows: DataFrame, findings: DataFrame, benchmark: str, id: str) -> DataFrame:
    """For each benchmark: rows, issues, rows that passed and failed the smoke, and a count of each kind (zero if it has none). Ids are those of one benchmark's row."""
    sums = rows.groupBy(benchmark).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("smoke_ok", F.lit(False))).alias("smoke_pass"), F.count_if(~F.coalesce("smoke_ok", F.lit(False))).alias("smoke_fail"))
    kinds = findings.join(rows.select(id, benchmark), id).groupBy(benchmark).agg(F.count(F.lit(1)).alias("issues"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return sums.join(kinds, benchmark, "left").select(benchmark, "rows", zero("issues"), "smoke_pass", "smoke_fail", *map(zero, KINDS))
