"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Texts and benchmark items are normalised (A-Z to lower case, everything but
letters and digits to single spaces). An item of L >= ``FUZZY`` characters may occur
with up to e = L // 10 edits. Each edit destroys at most q of the item's L - q + 1
q-grams, so a region with at most e edits shares at least L - q + 1 - q e of them, on
diagonals (position in the text less position in the item) that differ by at most e.
q is 8, or L // (e + 1) where that is less (seven for 30 and 31 characters), so the bound
is one at least. Diagonals fall in bands of width ``BAND`` that overlap by the edit budget,
so one band holds them all. Shared q-grams are counted by (text, item, band) in pieces of
at most ``PAIRS`` shared q-grams; bands below the item's bound go as soon as the text has
left them, the others are verified by an alignment of the whole item that is computed on
the band's diagonals only and must stay within the budget. A q-gram of the item counts
once a band and piece, so a repetitive text may be aligned more often, never less.

Shorter items may be common words in another order: they must occur without an edit,
as whole words, and are looked up by the hash of the whole item at every word start.

Items go to the workers in blocks of at most ``BLOCK_BYTES``; a larger benchmark takes
more passes over the texts, never a larger broadcast. Each text is searched in its
task, whole, in slices of bounded size; nothing is shuffled but the hits.

Cases: null and empty texts have no hits. Null items, and items without any letter or
digit, have nothing to look for. Repeated items each have their hits; repeated rows
too. Of several regions of one text that match one item, the one with the fewest edits
is returned, then the first. An empty table on either side gives no hits. Further
columns of the input play no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.ppm import Lookup
from strandline.llm.textkit import LOWER, U64, slices, span_hashes, texts, thrifty
from strandline.runtime import shared_table, ship

Q = 8
#: Characters of an item for each edit allowed.
RATE = 10
#: Characters from which an item may have edits; shorter ones match as whole words.
FUZZY = 24
#: Width of a band of diagonals, without its overlap.
BAND = 64
BLOCK_BYTES = 4 << 20
#: Shared q-grams that are held at a time, and cells of alignments (one q-gram's items or one item may take more).
PAIRS, CELLS = 1 << 20, 1 << 22
#: Blocks of items that one pass over the texts looks for.
PASS_BLOCKS = 4

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def normalise(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, place of each in ``raw``, first byte of each text) of normalised texts.

    A kept space stands for a run of other characters behind a word.
    """
    buf = LOWER[raw]
    word = _WORD[buf]
    keep = word.copy()
    keep[1:] |= word[:-1]
    starts = cuts[1:-1]
    starts = starts[starts < len(buf)]
    keep[starts] = word[starts]
    if len(keep):
        keep[0] = word[0]
    place = np.flatnonzero(keep)
    return np.where(word[place], buf[place], 0x20).astype(np.uint8), place, np.searchsorted(place, cuts)


def codes(b: np.ndarray, q: int = Q) -> np.ndarray:
    """Every q-gram as one number."""
    if len(b) < q:
        return np.zeros(0, U64)
    out = np.zeros(len(b) - q + 1, U64)
    for j in range(q):
        out = (out << U64(8)) | b[j : len(b) - q + 1 + j]
    return out


def budget(length: int) -> tuple[int, int, int]:
    """(edits allowed, q, q-grams that a region must share) for an item of ``length`` >= ``FUZZY`` characters."""
    edits = length // RATE
    q = min(Q, length // (edits + 1))
    return edits, q, length - q + 1 - q * edits


def align(items: list[np.ndarray], windows: list[np.ndarray], lows: list[int], width: int) -> list[tuple[int, int]]:
    """(fewest edits, end) of an occurrence of each item in its text, on ``width`` diagonals from its low one.

    Row i holds the cells j = i + low + d for d = 0 .. width - 1; cells outside
    the text cost more than any budget. All alignments advance together, longest
    item first, so that finished ones drop off the end.
    """
    order = sorted(range(len(items)), key=lambda x: -len(items[x]))
    length = np.array([len(items[x]) for x in order])
    top, far = int(length.max()), 1 << 20
    low = np.array([lows[x] for x in order])[:, None]
    size = np.array([len(windows[x]) for x in order])[:, None]
    pattern = np.full((len(order), top), -2, np.int16)
    text = np.full((len(order), top + width), -1, np.int16)  # the text from its low diagonal on; -1 equals nothing
    for n, x in enumerate(order):
        pattern[n, : length[n]] = items[x]
        lo, hi = max(0, lows[x]), min(len(windows[x]), lows[x] + top + width)
        if lo < hi:
            text[n, lo - lows[x] : hi - lows[x]] = windows[x][lo:hi]
    diagonal = np.arange(width, dtype=np.int32)[None]
    j = diagonal + low
    row = np.where((j >= 0) & (j <= size), 0, far).astype(np.int32)
    active = len(order)
    for i in range(1, top + 1):
        active = int(np.searchsorted(-length, -i, "right"))
        r = row[:active]
        new = r + (text[:active, i - 1 : i - 1 + width] != pattern[:active, i - 1 : i])
        np.minimum(new[:, :-1], r[:, 1:] + 1, out=new[:, :-1])
        j = diagonal + (low[:active] + i)
        outside = (j < 0) | (j > size[:active])
        new[outside] = far
        r[:] = np.minimum.accumulate(new - diagonal, axis=1) + diagonal
        r[outside] = far
    best = row.argmin(1)
    out: list[tuple[int, int]] = [(far, 0)] * len(order)
    for n, x in enumerate(order):
        out[x] = int(row[n, best[n]]), int(best[n]) + lows[x] + len(items[x])
    return out


class Grams:
    """Index of the q-grams of the items with one q."""

    def __init__(self, q: int, numbers: list[int], items: list[np.ndarray]):
        self.q = q
        grams = [codes(b, q) for b in items]
        code = np.concatenate([np.zeros(0, U64), *grams])
        item = np.repeat(np.array(numbers, np.int64), [len(g) for g in grams])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(code, kind="stable")
        self.item, self.at = item[order], at[order]
        known, start = np.unique(code[order], return_index=True)
        self.start = np.concatenate((start, [len(code)]))
        self.lookup = Lookup(known.view(np.int64), np.arange(len(known)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._hash(known)] = True

    @staticmethod
    def _hash(code: np.ndarray) -> np.ndarray:
        return ((code * U64(0x9E3779B97F4A7C15)) >> U64(44)).astype(np.int64)

    def shared(self, buf: np.ndarray, firsts: np.ndarray):
        """Pieces (position, text, position in the item, item) of the q-grams that texts and items share, by position."""
        code = codes(buf, self.q)
        pos = np.flatnonzero(self.maybe[self._hash(code)]) if len(code) else np.zeros(0, np.int64)
        doc = np.searchsorted(firsts, pos, "right") - 1
        ok = pos + self.q <= firsts[doc + 1] if len(pos) else np.zeros(0, bool)
        pos, doc = pos[ok], doc[ok]
        found = self.lookup.find(code[pos].view(np.int64))
        hit = found >= 0
        pos, doc = pos[hit], doc[hit]
        gram = self.lookup.values[0][found[hit]]
        sizes = self.start[gram + 1] - self.start[gram]
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(pos):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + PAIRS, "right")))
            many = sizes[lo:hi]
            which = np.repeat(self.start[gram[lo:hi]], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            yield np.repeat(pos[lo:hi], many), np.repeat(doc[lo:hi], many), self.at[which], self.item[which]
            lo = hi


class Items:
    """One block of benchmark items with the indexes to find them."""

    def __init__(self, ids: list[int], items: list[str]):
        self.ids, self.text = [], []
        for i, t in zip(ids, items, strict=True):
            raw = np.frombuffer(t.encode(), np.uint8)
            b, _, _ = normalise(raw, np.array([0, len(raw)]))
            if len(b) and b[-1] == 0x20:
                b = b[:-1]
            if len(b):
                self.ids.append(i)
                self.text.append(b)
        self.length = np.array([len(b) for b in self.text], np.int64)
        bounds = [budget(n) if n >= FUZZY else (0, 0, 0) for n in self.length.tolist()]
        self.edits, q, self.least = (np.array([x[k] for x in bounds], np.int64) for k in (0, 1, 2))
        self.band = max([BAND, *(1 << int(e + 1).bit_length() for e in self.edits)])
        self.grams = [Grams(k, np.flatnonzero(q == k).tolist(), [self.text[i] for i in np.flatnonzero(q == k)]) for k in np.unique(q[q > 0]).tolist()]
        self.short: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(q == 0).tolist():
            h = int(span_hashes(self.text[k], np.array([0]), np.array([len(self.text[k])]))[0])
            self.short.setdefault(len(self.text[k]), {}).setdefault(h, []).append(k)

    def whole_words(self, buf: np.ndarray, firsts: np.ndarray):
        """(text, item, start) of the short items, by place."""
        if not self.short or not len(buf):
            return
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        open_ = np.concatenate(([True], (buf[:-1] == 0x20) | (text[1:] != text[:-1]))) & (buf != 0x20)
        starts = np.flatnonzero(open_)
        ends = firsts[text[starts] + 1]
        for length, known in sorted(self.short.items()):
            fits = starts + length <= ends
            s, end = starts[fits], ends[fits]
            s = s[(s + length == end) | (buf[np.minimum(s + length, len(buf) - 1)] == 0x20)]
            h = span_hashes(buf, s, s + length)
            for i in np.flatnonzero(np.isin(h, np.array(list(known), U64))).tolist():
                for k in known[int(h[i])]:
                    if np.array_equal(buf[s[i] : s[i] + length], self.text[k]):
                        yield int(text[s[i]]), k, int(s[i] - firsts[text[s[i]]])

    def candidates(self, buf: np.ndarray, firsts: np.ndarray):
        """Lists of (text, item, band) that share enough q-grams; a band comes once."""
        wide = (int(np.diff(firsts).max()) + int(self.length.max())) // self.band + 2 if len(self.ids) else 0
        slack = self.band + int(self.edits.max()) if len(self.ids) else 0
        for grams in self.grams:
            key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)

            def enough(key, count):
                key = key[count >= self.least[key // wide % len(self.ids)]]
                return list(zip((key // wide // len(self.ids)).tolist(), (key // wide % len(self.ids)).tolist(), (key % wide).tolist(), strict=True))

            for pos, doc, at, item in grams.shared(buf, firsts):
                here, text = int(pos[-1] - firsts[doc[-1]]), int(doc[-1])
                # diagonals are counted from the item's full length before the text's start, so none is negative
                diagonal = pos - firsts[doc] - at + self.length[item]
                band = diagonal // self.band
                also = np.flatnonzero((diagonal % self.band < self.edits[item]) & (band > 0))
                new = (doc * len(self.ids) + item) * wide + band
                new, at = np.concatenate((new, new[also] - 1)), np.concatenate((at, at[also]))
                order = np.lexsort((at, new))
                new, at = new[order], at[order]
                new = new[np.concatenate(([True], (new[1:] != new[:-1]) | (at[1:] != at[:-1])))]
                kinds, n = np.unique(new, return_counts=True)
                key, back = np.unique(np.concatenate((key, kinds)), return_inverse=True)
                count = np.bincount(back, np.concatenate((count, n))).astype(np.int64)
                # no later q-gram falls in a band that ends before this position
                past = (key // wide // len(self.ids) < text) | (key % wide * self.band + slack < here)
                if found := enough(key[past], count[past]):
                    yield found
                key, count = key[~past], count[~past]
            if found := enough(key, count):
                yield found

    def verify(self, found: list[tuple[np.ndarray, int, int]]) -> list[tuple[int, int, int] | None]:
        """(edits, start, end) of item k in a normalised text on a band, or None, for each (text, k, band)."""
        out: list[tuple[int, int, int] | None] = []
        width = self.band + 3 * int(self.edits.max()) + 1
        most = max(1, min(128, CELLS // (int(self.length.max()) + 2 * width)))
        for n in range(0, len(found), most):
            part = found[n : n + most]
            lows = [band * self.band - int(self.length[k]) - int(self.edits[k]) for _, k, band in part]
            for (text, k, _), (edits, end) in zip(part, align([self.text[k] for _, k, _ in part], [x for x, _, _ in part], lows, width), strict=True):
                item, e = self.text[k], int(self.edits[k])
                if edits > e:
                    out.append(None)
                elif edits == 0:
                    out.append((0, end - len(item), end))
                else:  # the same alignment read backwards finds its start
                    lo = max(0, end - len(item) - e)
                    [(_, back)] = align([item[::-1]], [text[lo:end][::-1]], [-e], 2 * e + 1)
                    out.append((edits, end - back, end))
        return out


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_chars", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_HITS_SQL = "doc_id long, item_id long, edits int, item_chars int, start long, end long"


def search(items: Items, column):
    """(row, item number, edits, start, end) of every text of a column; byte offsets in the text."""
    offsets, raw = texts(column)
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        cuts = offsets[a : b + 1] - lo
        buf, place, firsts = normalise(raw[lo:hi], cuts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, k, start in items.whole_words(buf, firsts):
            best.setdefault((doc, k), (0, start, start + int(items.length[k])))
        for found in items.candidates(buf, firsts):
            checked = items.verify([(buf[int(firsts[doc]) : int(firsts[doc + 1])], k, band) for doc, k, band in found])
            for (doc, k, _), place_in in zip(found, checked, strict=True):
                if place_in and place_in < best.get((doc, k), (1 << 30, 0, 0)):
                    best[doc, k] = place_in
        for (doc, k), (edits, start, end) in sorted(best.items()):
            at = int(firsts[doc])
            yield a + doc, k, edits, int(place[at + start] - cuts[doc]), int(place[at + end - 1] + 1 - cuts[doc])


def _search(shared):
    def run(batches):
        items = None
        for t in batches:
            if items is None:
                items = Items(*shared.value)
            doc = t.column("doc_id").to_pylist()
            hits = [(doc[i], items.ids[k], edits, int(items.length[k]), start, end) for i, k, edits, start, end in search(items, t.column("text"))]
            yield pa.record_batch([pa.array([h[i] for h in hits], f.type) for i, f in enumerate(_HITS)], schema=_HITS)

    return run


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str):
    """Blocks (ids, texts) of at most ``BLOCK_BYTES`` each, fetched one at a time."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    ids, held, size = [], [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        held.append(r["text"])
        size += len(r["text"].encode())
        if size >= BLOCK_BYTES:
            yield ids, held
            ids, held, size = [], [], 0
    if ids:
        yield ids, held


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, item_chars, start, end (byte offsets) of benchmark items in texts."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = [rows.mapInArrow(thrifty(_search(spark.sparkContext.broadcast(block))), _HITS_SQL) for block in blocks_of(benchmark, item_col, item_text)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _HITS_SQL)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item. Rows never leave their task, but between passes for a large benchmark."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text_col)
    for n, block in enumerate(blocks_of(benchmark, item_col, item_text)):
        if n and n % PASS_BLOCKS == 0:  # a worker for each block of a pass holds its index
            docs = shared_table(docs, "clean-so-far")
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = None
            for t in batches:
                if items is None:
                    items = Items(*shared.value)
                keep = np.ones(len(t), bool)
                keep[[i for i, *_ in search(items, t.column(at))]] = False
                yield t.filter(pa.array(keep))

        docs = docs.mapInArrow(thrifty(run), docs.schema)
    return docs


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in the whole of ``documents``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
