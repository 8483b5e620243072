"""Texts of tasks: descriptions out of comments, notes, prompts, and harnesses that report what they found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions.code import without_fences


def bare(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def tail_free(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")


def comment_body(text: Column, requirement: str) -> Column:
    """What the first block comment says, or else the whole text: its lines without stars and blank lines before them, up to one that begins with `requirement`, no empty function at the end, one blank line at most between others."""
    whole = without_fences(F.coalesce(text, F.lit("")))
    begin = F.locate("/*", whole)
    after = F.substr(whole, begin + 2)
    end = F.locate("*/", after)
    said = F.when((begin > 0) & (end > 0), F.substr(after, F.lit(1), end - 1)).otherwise(whole)
    # Blank lines before a starred one go, and so do lines of nothing but a star.
    starred = F.split(F.regexp_replace(said, r"\n\s*\n(?=[ \t]*\*)", "\n"), "\n")
    plain = F.filter(F.transform(starred, lambda line: F.when(F.ltrim(line) == "*", F.lit(None)).when(F.startswith(F.ltrim(line), F.lit("*")), F.regexp_replace(F.substr(F.ltrim(line), F.lit(2)), r"^[ \t]", "")).otherwise(line)), lambda line: line.isNotNull())
    stops = F.filter(F.transform(plain, lambda line, i: F.struct(i.alias("i"), F.startswith(F.lower(F.ltrim(line)), F.lit(requirement.lower())).alias("stop"))), lambda x: x["stop"] & (x["i"] > 0))
    kept = F.array_join(F.when(F.size(stops) > 0, F.slice(plain, F.lit(1), F.get(stops, 0)["i"])).otherwise(plain), "\n")
    kept = F.regexp_replace(kept, r"\n[ \t]*[A-Za-z_][^\n;{}()]*\([^;{}]*\)\s*\{\s*\}\s*$", "")
    return bare(F.regexp_replace(kept, "\n\n\n+", "\n\n"))


def with_notes(description: Column, notes: dict[str, Column]) -> Column:
    """A description and, below it, each note whose rule holds, in order."""
    found = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(note)) for note, rule in notes.items())), lambda n: n.isNotNull())
    return F.when(F.size(found) > 0, F.concat(tail_free(description), F.lit("\n\n"), F.array_join(found, "\n"))).otherwise(bare(description))


def prompt_text(signature: Column, description: Column, prelude: Column, include: str, requirement: str) -> Column:
    """Include, prelude (if there is one), the description as a comment that holds the requirement once, and the empty function."""
    said = F.when(F.contains(bare(description), F.lit(requirement)), bare(description)).otherwise(F.concat(bare(description), F.lit("\n\n" + requirement)))
    parts = F.array(F.lit(include), F.nullif(bare(prelude), F.lit("")), F.concat(F.lit("/*\n"), bare(said), F.lit("\n*/")), F.concat(bare(signature), F.lit(" {\n}")))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))


def reporting_harness(harness: Column, name: str = "checked_main") -> Column:
    """A harness whose main reports `correctness`: one that says so itself stays; else its main is renamed and called by one that prints whether it returned 0."""
    # Fixed value: the line that a harness prints.
    body = without_fences(F.coalesce(harness, F.lit("")))
    head = r"\bint\s+main\s*\(\s*(?:void\s*)?\)"
    before = F.regexp_extract(body, rf"^((?s:.*?)){head}((?s:.*))$", 1)
    after = F.regexp_extract(body, rf"^((?s:.*?)){head}((?s:.*))$", 2)
    report = f'int main(void) {{\n    int rc = {name}();\n    printf("{{ \\"correctness\\": %s }}\\n", rc == 0 ? "1" : "0");\n    return 0;\n}}\n'
    wrapped = F.concat(tail_free(F.concat(before, F.lit(f"static int {name}(void)"), after)), F.lit("\n\n" + report))
    return F.when(F.contains(body, F.lit('"correctness"')) | ~F.rlike(body, F.lit(head)), body).otherwise(wrapped)


def extern_declaration(signature: Column) -> Column:
    return F.concat(F.lit("extern "), F.regexp_replace(bare(signature), ";+$", ""), F.lit(";"))


def strategy(listed: Column, prelude: Column, signature: Column, names: tuple[str, ...]) -> Column:
    """struct(strategy, needs_context, reasons) of a task: the strategy that a table lists for it, else pure; context where its prelude defines something, or its signature has a standard type or one of `names`."""
    # Words that begin a definition.
    chosen = F.coalesce(listed, F.lit("pure"))
    defines = F.rlike(F.coalesce(prelude, F.lit("")), F.lit(r"(?m)^\s*(?:#define|typedef|using|enum)\b"))
    special = F.exists(F.array(F.lit("std::"), *map(F.lit, names)), lambda n: F.contains(F.coalesce(signature, F.lit("")), n))
    reasons = F.filter(F.array(F.when(chosen == "sequential", "order of work matters").when(chosen == "hybrid", "scalar control around vector work").otherwise("one loop of vector work"), F.when(defines, "prelude defines names"), F.when(special, "signature has types of its own")), lambda r: r.isNotNull())
    return F.struct(chosen.alias("strategy"), (defines | special).alias("needs_context"), reasons.alias("reasons"))
