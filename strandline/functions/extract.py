"""Mentions in text, canonical numbers, cleaned fields and question traits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.vocab import ABBREVIATIONS, CLAUSE, DATE_FORMS, DOCUMENTARY, EXTRACTABLE_TYPES, FUNCTIONAL_LOCATION, LIVE_MARKER, MEASUREMENT, QUANTITY, QUESTION_KINDS, REFERENCE, WORTH_KINDS

#: Shortest text that can tell causes, shortest restated question in words, and most of them.
LEAST_CHARS, LEAST_WORDS, MOST_PARTS = 120, 4, 4
LOGIT = 12.0


def canonical_reference(c: Column) -> Column:
    """``sop 4412`` and ``Sop4412`` as ``SOP-4412``."""
    s = F.regexp_replace(F.upper(F.trim(c)), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(s, r"^([A-Z&]+?)-?(\d)", "$1-$2"), "-{2,}", "-")


def references(c: Column) -> Column:
    """Document and standard references of a text in order, canonical."""
    return F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), 0), canonical_reference)


def masked(c: Column) -> Column:
    """A text whose document references are blanked, so that they don't parse as tags."""
    return F.regexp_replace(c, REFERENCE, " ")


def clauses(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CLAUSE), 1)


def functional_locations(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(FUNCTIONAL_LOCATION), 1), lambda x: F.trim(x))


def quantities(c: Column) -> Column:
    """array<struct(value, unit)>: numbers that have a unit."""
    value, unit = (F.regexp_extract_all(c, F.lit(QUANTITY), i) for i in (1, 2))
    return F.transform(F.arrays_zip(value.alias("value"), unit.alias("unit")), lambda x: F.struct(x["value"].cast("double").alias("value"), x["unit"].alias("unit")))


def dates(c: Column) -> Column:
    """Dates of a text, pattern by pattern; what no calendar has is left out."""

    def found(pattern: str, form: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), lambda x: F.try_to_timestamp(F.regexp_replace(x, r"\s+", " "), F.lit(form)).cast("date"))

    return F.array_compact(F.concat(*(found(p, f) for p, f in DATE_FORMS)))


def first_date(*texts: Column) -> Column:
    """The first date of the first text that has one."""
    return F.coalesce(*(F.get(dates(F.coalesce(t, F.lit(""))), 0) for t in texts))


def status(c: Column) -> Column:
    """The leading token of a status or severity line, upper case, 40 characters at most; null if there is none."""
    token = F.upper(F.trim(F.get(F.split(F.trim(c), r"\s+--\s+|\s+-\s+|,", 2), 0)))
    return F.when(token != "", F.substring(token, 1, 40))


def safe_filename(c: Column) -> Column:
    """The last part of a client's path without unsafe characters, ``unnamed`` if nothing is left. Compose the name (NFKC) before."""
    base = F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(base, r'[<>:"|?*\p{Cntrl}]', ""), r"^[\s.]+|[\s.]+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "unnamed").otherwise(clean)


def title(given: Column, filename: Column) -> Column:
    """A given title of more than three characters, else the file's stem with spaces, 300 characters at most."""
    own = F.trim(F.coalesce(given, F.lit("")))
    stem = F.trim(F.translate(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), "_-", "  "))
    return F.when(F.length(own) > 3, F.substring(own, 1, 300)).otherwise(F.coalesce(F.nullif(F.substring(stem, 1, 300), F.lit("")), filename))


def plain_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[_\-\s]+", " "))


def without_fence(c: Column) -> Column:
    """A reply without the code fence around it."""
    s = F.trim(c)
    inner = F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.trim(F.when(s.startswith("```"), inner).otherwise(s))


def expanded(c: Column) -> Column:
    """Known abbreviations of two to five letters written out."""
    words = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    runs = F.split(c, r"(?<=[^A-Za-z0-9_/])|(?=[^A-Za-z0-9_/])")
    return F.array_join(F.transform(runs, lambda x: F.when(F.length(x).between(2, 5), F.coalesce(F.try_element_at(words, F.lower(x)), x)).otherwise(x)), "")


def iso_day(c: Column) -> Column:
    """The date that the first ten characters are, else null."""
    ten = F.substring(c, 1, 10)
    return F.when(ten.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(ten, F.lit("yyyy-MM-dd")).cast("date"))


def asks_for_live_state(c: Column) -> Column:
    """A question for the present value of a measurement, which no document holds."""
    return c.rlike(LIVE_MARKER) & ~c.rlike(DOCUMENTARY) & c.rlike(MEASUREMENT)


def aggregation(c: Column) -> Column:
    """What a question wants summed up; count if it does not say."""
    out = F.lit("count")
    for kind, pattern in reversed(QUESTION_KINDS):
        out = F.when(F.lower(c).rlike(pattern), kind).otherwise(out)
    return out


def distinct_parts(parts: Column, question: Column) -> Column:
    """Sub-questions in order without empty, short and repeated ones and the question itself."""
    key = lambda x: F.regexp_replace(F.lower(x), r"^[ ?]+|[ ?]+$", "")
    rows = F.transform(parts, lambda x: F.struct(key(x).alias("key"), x.alias("part")))
    kept = F.filter(rows, lambda x: (x["key"] != key(question)) & (F.size(F.split(F.trim(x["key"]), r"\s+")) >= LEAST_WORDS))
    first = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, lambda y: y["key"]), x["key"]) == i + 1)
    return F.slice(F.transform(first, lambda x: x["part"]), 1, MOST_PARTS)


def worth_extracting(kind: Column, text: Column, failures: Column) -> Column:
    """Whether a chunk can hold a causal story: its kind, its length, and words of failure."""
    return kind.isin(WORTH_KINDS) & (F.length(text) >= LEAST_CHARS) & failures


def extractable(doc_type: Column) -> Column:
    return doc_type.isin(EXTRACTABLE_TYPES)


def reranker_share(logit: Column) -> Column:
    """A reranker's logit on a scale from 0 to 1, four decimals; 0 where there is none.

    Scaled before it is rounded, as SQL does on doubles: ``round(x, 4)`` goes by the shortest
    decimals of x, so it differs where a share lies next to the middle of two steps.
    """
    share = (F.least(F.greatest(logit, F.lit(-LOGIT)), F.lit(LOGIT)) + LOGIT) / (2 * LOGIT)
    return F.coalesce(F.round(share * 10000.0) / 10000.0, F.lit(0.0))


def rerank_key(model: Column, query: Column, passages: Column) -> Column:
    """SHA-256 over model, query and passages, divided by NUL."""
    return F.sha2(F.concat_ws("\0", model, query, passages), 256)
