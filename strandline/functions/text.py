"""Text expressions shared by index and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(c: Column) -> Column:
    """White space runs to one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def stem(c: Column) -> Column:
    """Drops a plural s of words over three letters, unless the word ends in ss, us or is."""
    plural = (F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss") & ~c.endswith("us") & ~c.endswith("is")
    return F.when(plural, c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def sentences(c: Column, least: int = 30, most: int = 420) -> Column:
    """Sentences of a text after soft line wraps are joined; only lengths ``least`` to ``most`` stay."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " ")
    return F.filter(F.transform(F.split(joined, r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s).between(least, most))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def contains_quote(text: Column, quote: Column) -> Column:
    """Whether a squashed, non-empty quote stands in the squashed text."""
    q = squash(F.coalesce(quote, F.lit("")))
    return (F.length(q) > 0) & F.coalesce(squash(text).contains(q), F.lit(False))


def covers(term: Column, other: Column, prefix: int = 4) -> Column:
    """Equal, or one a prefix of the other and both at least ``prefix`` long."""
    long = (F.length(term) >= prefix) & (F.length(other) >= prefix)
    return (term == other) | (long & (term.startswith(other) | other.startswith(term)))


def document_id(content: Column) -> Column:
    """``doc_`` and the first 24 hex digits of the content's SHA-256."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 24))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("long"))), -1, 1)
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def multi_format_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "d MMM yyyy", "d-MMM-yyyy", "yyyy/MM/dd")) -> Column:
    """The first format that fits decides; day first wins over month first."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats))
