"""Index terms of a text: one function for texts and questions, so that both sides always agree.

A text is cut at everything but letters, digits, quotes, hyphens, underscores, slashes
and dots. References (``SOP-4412``) and tags stay whole, tags in canonical form, also
when they are written with spaces (``P 101 B``); other pieces are lower-cased, stop words
and single characters go and a plural s comes off. Whole columns are worked on in Arrow
batches; a worker remembers the term of every piece it has met.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from strandline.functions import tags as T
from strandline.functions.vocab import EQUIPMENT_CLASSES, ISA_FIRST, ISA_SUCCEEDING, SEGMENT_WORDS, STOPWORDS, WHOLE_REFERENCE

#: Bytes of pieces and their terms that a worker remembers, with what a dictionary and two strings take besides.
CACHE_BYTES, PIECE_BYTES = 24 << 20, 240

_CUT = re.compile(r"[^A-Za-z0-9\"'’\-‐-―_/.]+")
_EDGE = re.compile(r"^[\-_.'\"’]+|[\-_.'\"’]+$")
_WHOLE = re.compile(WHOLE_REFERENCE)
_SPACED = re.compile(r"\b([A-Za-z]{1,4})\s+([0-9]{2,5})(?:\s*([A-Za-z]))?\b")
_STOP = frozenset(STOPWORDS)
_SHAPES = [("line", re.compile(T.LINE)), ("kks", re.compile(T.KKS)), ("instrument", re.compile(T.INSTRUMENT)), *(("equipment", re.compile(p)) for p in T.EQUIPMENT)]


def instrument(letters: str) -> bool:
    return letters[:1] in ISA_FIRST and all(x in ISA_SUCCEEDING for x in letters[1:])


def _number(digits: str) -> str:
    return digits.lstrip("0") or digits[-1:]


def tag_of(surface: str) -> str | None:
    """The canonical form of a surface that parses as a tag, else null; the same grammar as ``tags``."""
    text = re.sub(T.SEPARATORS, "-", unicodedata.normalize("NFKC", surface).upper().strip(" "))
    parts = [SEGMENT_WORDS.get(x, x) for x in re.sub(r'[^A-Z0-9\-"]', "", text).split("-") if x]
    norm = "-".join(_number(x) if re.fullmatch("[0-9]+", x) else x for x in parts)
    whole = norm.replace("-", "")
    for kind, shape in _SHAPES:
        m = shape.match(whole)
        if not m:
            continue
        if kind in ("line", "kks"):
            return norm
        cls, seq = m.group(2), _number(m.group(3))
        if kind == "instrument" and cls not in EQUIPMENT_CLASSES and instrument(cls):
            return f"{cls}-{seq}"
        if kind == "equipment" and cls in EQUIPMENT_CLASSES:
            return f"{cls}-{seq}{m.group(4) or ''}"
    return None


def _joined(m: re.Match) -> str:
    letters = m.group(1).upper()
    if letters.lower() in _STOP or not (letters in EQUIPMENT_CLASSES or instrument(letters)):
        return m.group(0)
    return f"{letters}-{m.group(2)}{(m.group(3) or '').upper()}"


def term_of(piece: str) -> str:
    """The term of one piece, empty if it has none."""
    piece = _EDGE.sub("", piece)
    if any("0" <= x <= "9" for x in piece):
        if _WHOLE.match(piece):
            return piece.lower()
        tag = tag_of(piece)
        if tag:
            return tag.lower()
    low = piece.lower()
    if len(low) < 2 or low in _STOP:
        return ""
    return low[:-1] if len(low) > 3 and low[-1] == "s" and low[-2:] not in ("ss", "us", "is") else low


class Terms:
    """Terms of texts, with a memory of pieces."""

    def __init__(self):
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.held = 0

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        out, known = [], self.known
        for piece in _CUT.split(_SPACED.sub(_joined, text)):
            term = known.get(piece)
            if term is None:
                term = self.older.get(piece)
                if term is None:
                    term = term_of(piece)
                self.held += PIECE_BYTES + 2 * len(piece)
                if self.held > CACHE_BYTES // 2:  # what is asked for again comes over from the older half
                    self.older, self.known, self.held = known, {}, PIECE_BYTES + 2 * len(piece)
                    known = self.known
                known[piece] = term
            if term:
                out.append(term)
        return out


_MEMORY = Terms()


@F.pandas_udf(ArrayType(StringType()))
def terms(texts: pd.Series) -> pd.Series:
    """Index terms of every text, in order; none for null."""
    return texts.map(_MEMORY)
