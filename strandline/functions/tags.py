"""The tag grammar as column expressions: normalise, parse, block, score, decide."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from strandline.functions.vocab import EQUIPMENT_CLASSES, ISA_FIRST, ISA_SUCCEEDING, MERGE_THRESHOLD, REVIEW_THRESHOLD, SEGMENT_WORDS

SEPARATORS = r"[\s\-‐‑‒–—―−_/\\.:]+"
LINE = r'^(\d{1,2}(?:\.\d)?)(?:"|IN)([A-Z]{1,3})(\d{3,5})([A-Z0-9]{2,6})?$'
KKS = r"^(\d{1,2})([A-Z]{3})(\d{2})([A-Z]{2})(\d{3})$"
INSTRUMENT = r"^(\d{0,3})([A-Z]{2,5})(\d{2,5})$"
EQUIPMENT = [
    r"^(\d{1,3})([A-Z]{1,2})(\d{2,5})([A-Z])?$",
    r"^([A-Z]{2,6}\d{0,2})([A-Z]{1,2})(\d{2,5})([A-Z])?$",
    r"^()([A-Z]{1,2})(\d{2,5})([A-Z])?$",
]


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def normalise(c: Column) -> Column:
    """Compatibility form, upper case, one hyphen between segments, words to class codes, leading zeros off numbers.

    Only surfaces beyond ASCII go through Python for their compatibility form.
    """
    c = F.coalesce(c, F.lit(""))
    plain = F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))
    s = F.regexp_replace(F.trim(F.upper(plain)), SEPARATORS, "-")
    s = F.regexp_replace(s, r'[^A-Z0-9\-"]', "")
    segments = F.filter(F.split(s, "-"), lambda x: x != "")
    words = _map(SEGMENT_WORDS)
    segments = F.transform(segments, lambda x: F.coalesce(F.try_element_at(words, x), x))
    segments = F.transform(segments, lambda x: F.when(x.rlike(r"^\d+$"), F.regexp_replace(x, r"^0+(?=.)", "")).otherwise(x))
    return F.array_join(segments, "-")


def instrument_function(letters: Column) -> Column:
    """What an ISA letter group measures and does, or null if any letter has no meaning."""
    first = F.try_element_at(_map(ISA_FIRST), F.substring(letters, 1, 1))
    rest = F.filter(F.split(letters.substr(F.lit(2), F.length(letters)), ""), lambda x: x != "")
    known = _map(ISA_SUCCEEDING)
    parts = F.transform(rest, lambda x: F.try_element_at(known, x))
    ok = first.isNotNull() & F.forall(parts, lambda x: x.isNotNull())
    short = F.transform(parts, lambda x: F.regexp_replace(x, r" [(/].*$", ""))
    return F.when(ok, F.concat_ws(" ", F.concat(F.array(first), short)))


def once(rows: DataFrame, c: Column, name: str) -> DataFrame:
    """``rows`` with a column that is worked out once a row, however often later expressions use it."""
    return rows.select("*", F.explode(F.array(c)).alias(name))


def with_tag(rows: DataFrame, surface: str, name: str = "tag") -> DataFrame:
    """``rows`` with the parsed tag of a column."""
    norm = f"_{name}_norm"
    return once(once(rows, normalise(F.col(surface)), norm), parse(F.col(norm)), name).drop(norm)


def parse(norm: Column) -> Column:
    """struct(normalised, compact, kind, unit, cls, seq, suffix, system) of a normalised tag: line, then KKS, instrument, equipment, else unparsed."""
    comp = F.replace(norm, F.lit("-"))
    at = lambda pattern, g: F.regexp_extract(comp, pattern, g)
    none = F.lit(None).cast("string")
    blank = lambda x: F.nullif(x, F.lit(""))
    zeros = lambda x: F.regexp_replace(x, r"^0+(?=.)", "")
    classes = F.array(*(F.lit(k) for k in EQUIPMENT_CLASSES))

    def of(kind: str, unit: Column, cls: Column, seq: Column, suffix: Column, system: Column) -> Column:
        return F.struct(
            norm.alias("normalised"), comp.alias("compact"), F.lit(kind).alias("kind"), unit.alias("unit"), cls.alias("cls"), seq.alias("seq"), suffix.alias("suffix"), system.alias("system")
        )

    out = F.when(comp.rlike(LINE), of("line", none, none, zeros(at(LINE, 3)), none, at(LINE, 2)))
    out = out.when(comp.rlike(KKS), of("kks", at(KKS, 1), none, at(KKS, 5), none, at(KKS, 2)))
    letters = at(INSTRUMENT, 2)
    instrument = comp.rlike(INSTRUMENT) & ~F.array_contains(classes, letters) & instrument_function(letters).isNotNull()
    out = out.when(instrument, of("instrument", blank(at(INSTRUMENT, 1)), letters, zeros(at(INSTRUMENT, 3)), none, none))
    for p in EQUIPMENT:
        out = out.when(comp.rlike(p) & F.array_contains(classes, at(p, 2)), of("equipment", blank(at(p, 1)), at(p, 2), zeros(at(p, 3)), blank(at(p, 4)), none))
    return out.otherwise(of("unparsed", none, none, none, none, none))


def canonical(tag: Column) -> Column:
    """Class, number and item letter without the unit; other kinds keep their normalised form."""
    short = F.concat(tag["cls"], F.lit("-"), tag["seq"], F.coalesce(tag["suffix"], F.lit("")))
    return F.when(tag["kind"].isin("equipment", "instrument"), short).otherwise(tag["normalised"])


def blocking_key(tag: Column) -> Column:
    """Key that keeps siblings together: it leaves the item letter out."""
    return (
        F.when(tag["kind"].isin("equipment", "instrument"), F.concat_ws("|", tag["kind"], tag["cls"], tag["seq"]))
        .when(tag["kind"].isin("line", "kks"), F.concat_ws("|", tag["kind"], tag["system"], tag["seq"]))
        .otherwise(F.concat(F.lit("unparsed|"), F.substring(tag["compact"], 1, 8)))
    )


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Winkler's similarity (prefix weight 0.1, up to four characters, from 0.7 on)."""
    return pd.Series([_jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def _jaro_winkler(x: str, y: str) -> float:
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    reach = max(0, max(len(x), len(y)) // 2 - 1)
    used = [False] * len(y)
    mine = []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not used[j] and y[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, u in zip(y, used, strict=True) if u]
    swaps = sum(p != q for p, q in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    jaro = (m / len(x) + m / len(y) + (m - swaps) / m) / 3
    same = 0
    while same < min(4, len(x), len(y)) and x[same] == y[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


def score_pair(a: Column, b: Column, alias: Column | None = None, similarity: Column | None = None, context: Column | None = None) -> Column:
    """struct(score, relation) of two parsed tags. ``similarity`` of unparsed ones comes from ``jaro_winkler``."""
    result = lambda s, r: F.struct(F.lit(s).cast("double").alias("score") if not isinstance(s, Column) else s.alias("score"), (F.lit(r) if not isinstance(r, Column) else r).alias("relation"))
    parsed = (a["kind"] != "unparsed") & (b["kind"] != "unparsed")
    core = a["cls"].eqNullSafe(b["cls"]) & a["seq"].eqNullSafe(b["seq"])
    suffix = a["suffix"].eqNullSafe(b["suffix"])
    conflict = a["unit"].isNotNull() & b["unit"].isNotNull() & (a["unit"] != b["unit"])
    sim = F.coalesce(similarity, F.lit(0.0)) if similarity is not None else F.lit(0.0)
    hint = F.least(F.lit(1.0), F.greatest(F.lit(0.0), context)) if context is not None else F.lit(0.0)
    fuzzy = F.least(F.lit(1.0), sim * 0.6 + hint * 0.2)
    out = F.when(alias, result(1.0, "SAME")) if alias is not None else F.when(F.lit(False), result(1.0, "SAME"))
    return (
        out.when(parsed & (a["kind"] != b["kind"]), result(0.05, "DIFFERENT"))
        .when(parsed & core & suffix & conflict, result(0.15, "DIFFERENT"))
        .when(parsed & core & suffix & a["unit"].eqNullSafe(b["unit"]), result(0.97, "SAME"))
        .when(parsed & core & suffix, result(0.85, "SAME"))
        .when(parsed & core, result(0.30, "SIBLING"))
        .when(parsed, result(0.10, "DIFFERENT"))
        .otherwise(result(fuzzy, F.when(fuzzy >= 0.45, "UNKNOWN").otherwise("DIFFERENT")))
    )


def decide(match: Column, merge: float = MERGE_THRESHOLD, review: float = REVIEW_THRESHOLD) -> Column:
    """What follows from a scored pair; siblings are linked, never merged."""
    return (
        F.when(match["relation"] == "SIBLING", "link_sibling")
        .when((match["relation"] == "SAME") & (match["score"] >= merge), "merge")
        .when(match["score"] >= review, "needs_review")
        .otherwise("separate")
    )
