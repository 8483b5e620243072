"""Column functions of the token layer. An expensive array goes through `barrier` before anything filters on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word pattern (ASCII first letter, Unicode rest) and numbers.
TOKEN = r"[a-z_][\p{L}\p{N}_]*|[0-9]+"


def tokens(text: Column) -> Column:
    """Words and numbers in lower case; other characters are dropped."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def canonical(text: Column) -> Column:
    """Tokens joined by a blank."""
    return F.array_join(tokens(text), " ")


def compact(text: Column) -> Column:
    """Whitespace squeezed and trimmed, Unicode blanks included."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def barrier(df: DataFrame, column: str) -> DataFrame:
    """`df` with `column` computed once: a Generate that predicates don't move through."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(F.col(column))).alias(column))


def shingles(toks: Column, width: int) -> Column:
    """Distinct runs of `width` tokens; fewer tokens are a set of themselves."""
    runs = F.transform(F.sequence(F.lit(1), F.size(toks) - width + 1), lambda i: F.array_join(F.slice(toks, i, F.lit(width)), " "))
    return F.array_distinct(F.when(F.size(toks) < width, toks).otherwise(runs))


def shingle_hashes(toks: Column, width: int) -> Column:
    """As `shingles`, each as a 64-bit hash of its tokens: no text is joined, and sets are of numbers."""
    runs = F.transform(F.sequence(F.lit(0), F.size(toks) - width), lambda i: F.xxhash64(*(F.get(toks, i + k) for k in range(width))))
    return F.array_distinct(F.when(F.size(toks) < width, F.transform(toks, lambda t: F.xxhash64(t))).otherwise(runs))


def hash60(x: Column) -> Column:
    """The top 60 bits of md5 as a bigint; other SQL engines agree on it."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("bigint")


def short_digest(x: Column) -> Column:
    """The first 16 hex digits of sha1."""
    return F.substring(F.sha1(x.cast("binary")), 1, 16)


def source_prefix(name: Column) -> Column:
    """Text before the first dot, else the leading alphanumerics, else the first 32 characters."""
    lead = F.regexp_extract(name, r"^[A-Za-z0-9]+", 0)
    return F.when(F.contains(name, F.lit(".")), F.split_part(name, F.lit("."), F.lit(1))).when(lead != "", lead).otherwise(F.left(name, F.lit(32)))


def file_name(x: Column) -> Column:
    """A name of letters, digits, `_.-`, at most 140 characters; `task` if nothing is left."""
    c = F.left(F.btrim(F.regexp_replace(x, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit(140))
    return F.when(c == "", "task").otherwise(c)


def clean_items(items: Column, most: int) -> Column:
    """Trimmed, blank ones dropped, first occurrences kept in order, at most `most`."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.array_distinct(kept), 1, most)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")
