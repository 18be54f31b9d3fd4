"""Language-model scoring by prediction by partial matching (PPM, escape method C).

A text is its token sequence: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased,
each followed by one space, and one end symbol. The model is a trie of byte
contexts of up to five bytes. In a context seen T times before D different
symbols, a symbol seen c times has probability c / (T + D) and the escape to the
next shorter context D / (T + D); symbols of longer contexts are excluded from
the counts of shorter ones. Below the empty context, symbols never seen share
what is left evenly. The start of a text counts as five spaces.

Pretrained mode counts context and symbol over all training texts and sums the
counts by bucket of the pair's hash. The trie is broadcast if it has at most
``MAX_GRAMS`` pairs of the highest order (64 MB); otherwise the order falls by
one until it fits, down to order one, which always does: 256 contexts of 257
symbols. Because the trained trie does not change, norms and escapes under
exclusion are worked out once a worker, and a byte costs one or a few lookups. Adaptive mode starts each text
with an empty trie and learns as it reads; nothing is shared between texts.

Whole mode, which the query uses, counts the same and keeps order five at every
size. A trie of more than ``MAX_GRAMS`` pairs is cut into blocks by the last two
bytes of the context. A context and its suffixes of two bytes or more share a
block; the pairs of order one and zero go with every block. Each block is
broadcast by itself and scores, in a pass over the texts, the symbols whose
contexts it owns; the parts of a text are added by its key. Scores are those of
the uncut trie. Two bytes that alone stand before more than ``MAX_GRAMS`` pairs
are a block of their own.

The unigram base needs the count of every word of the corpus. Words travel as
binary blobs by bucket of the word's hash: each map batch sends a word once with
the rows it occurs in. A bucket sums the counts and returns partial sums per
text. The vocabulary is thus never in one place.

Cases: null, empty and blank texts are the end symbol alone. Equal token
sequences share one key, are scored once a task, and get equal scores. Rows that
repeat a doc_id are rows of their own. Null ids count as training rows only if
the caller's flag says so (null: not). With no training rows every probability
is uniform over 257 symbols and the base over one unseen token. Further columns
play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.textkit import LOWER, SPACE, U64, mix, slices, span_hashes, texts, words
from strandline.runtime import join_groups, shared_table, ship

ORDER = 5
END = 256
SYMBOLS = 257
#: Context and symbol pairs of the highest order that are broadcast (16 bytes each).
MAX_GRAMS = 1 << 22
#: Words gathered by a map task before it writes blobs, and texts at most (they are numbered in 16 bits).
FLUSH_WORDS, FLUSH_TEXTS = 3_000_000, 60_000
BUCKET_WORDS = 4_000_000
#: Buckets that counts of (context, symbol) are summed in.
GRAM_BUCKETS = 256


def sequences(column):
    """For slices of a column: (a, b, symbols, scored, start of each text, word hashes, first word of each text).

    ``symbols`` holds each text behind ``ORDER`` spaces of padding and ends with END;
    ``scored`` marks what is not padding.
    """
    offsets, raw = texts(column)
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        buf = LOWER[raw[lo:hi]]
        s, e, firsts = words(buf, offsets[a : b + 1] - lo)
        hashes = span_hashes(buf, s, e)
        n = b - a
        counts = np.diff(firsts)
        doc_of_word = np.repeat(np.arange(n), counts)
        size = e - s
        shift = np.arange(len(s)) + ORDER * (doc_of_word + 1) + doc_of_word
        solid = np.flatnonzero(~SPACE[buf])
        letters = int(size.sum())
        total = letters + len(s) + (ORDER + 1) * n
        symbols = np.full(total, 0x20, np.int16)
        symbols[np.arange(letters) + np.repeat(shift, size)] = buf[solid]
        per_text = np.bincount(doc_of_word, size + 1, n).astype(np.int64) + ORDER + 1
        start = np.concatenate(([0], np.cumsum(per_text)))
        symbols[start[1:] - 1] = END
        scored = np.ones(total, bool)
        scored[(start[:-1, None] + np.arange(ORDER)).ravel()] = False
        yield a, b, symbols, scored, start, hashes, firsts


def contexts(symbols: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The ``order`` bytes before each symbol as one number (the first ``order`` entries are void)."""
    c = (symbols & 0xFF).astype(np.int64)
    out = np.zeros(len(c), np.int64)
    for j in range(order, 0, -1):
        out[order:] = (out[order:] << 8) | c[order - j : len(c) - j]
    return out


def text_keys(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each token sequence."""
    n = np.diff(firsts)
    at = np.arange(len(hashes)) - np.repeat(firsts[:-1], n)
    h = mix(hashes + mix(at.astype(U64) + U64(1)))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(h)))
    return mix(total[firsts[1:]] - total[firsts[:-1]] + n.astype(U64)).view(np.int64)


# -- the trie ---------------------------------------------------------------


class Lookup:
    """Numbers by key: keys sorted by their mixed value, found through an index on its top bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        mixed = mix(keys.astype(U64))
        order = np.argsort(mixed)
        self.mixed, self.values = mixed[order], [v[order] for v in values]
        self.shift = U64(64 - max(4, len(keys).bit_length()))
        top = (self.mixed >> self.shift).astype(np.int64)
        self.start = np.searchsorted(top, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        mixed = mix(keys.astype(U64))
        top = (mixed >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(mixed), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.mixed[at[todo]] == mixed[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def take(self, which: int, at: np.ndarray, default: float = 0.0) -> np.ndarray:
        v = self.values[which]
        return np.where(at >= 0, v[np.maximum(at, 0)], default) if len(v) else np.full(len(at), default)


def _log(x) -> np.ndarray:
    return np.log10(x).astype(np.float32)


class Model:
    """A trained trie with what scoring needs worked out beforehand.

    For a symbol of a context: log10 of its count. For a context of k bytes: log10
    of the norm T + D and of the escape D / (T + D) of its own counts, and the
    same two of the counts of the next shorter context without the symbols seen
    here. Symbols seen in a context are also seen in all shorter ones, so those
    are all the exclusions there are. ``base`` has the keys and counts of order one
    of the whole trie, if ``key`` is only a block of it.
    """

    def __init__(self, order: int, key: np.ndarray, n: np.ndarray, base: tuple[np.ndarray, np.ndarray] | None = None):
        self.order, self.grams, self.contexts = order, [], []
        levels = []
        for k in range(order, -1, -1):
            if base and k == 1:
                key, n = base
            key, inverse = np.unique(key & ((1 << (8 * k + 9)) - 1), return_inverse=True)
            n = np.bincount(inverse, n, len(key))
            levels.append((key, n))
        below = None
        for k, (key, n) in enumerate(reversed(levels)):
            if not len(key):
                key, n = np.zeros(0, np.int64), np.zeros(0)
            context = key >> 9
            start = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(key) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, start) if len(key) else np.zeros(0)
            kinds = np.diff(np.concatenate((start, [len(key)]))).astype(float)
            context = context[start]
            shorter = (np.zeros(len(start), np.float32),) * 2
            if k and len(key):
                key_, n_, context_, total_, kinds_ = below
                seen = np.add.reduceat(n_[np.searchsorted(key_, key & ((1 << (8 * k + 1)) - 1))], start)
                up = np.searchsorted(context_, context & ((1 << 8 * (k - 1)) - 1))
                more = kinds_[up] - kinds
                norm = np.maximum(total_[up] - seen + more, 1)
                shorter = _log(norm), np.where(more > 0, _log(np.maximum(more, 1) / norm), 0)
            self.contexts.append(Lookup(context, _log(np.maximum(total + kinds, 1)), _log(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), *shorter))
            self.grams.append(Lookup(key, _log(np.maximum(n, 1))))
            below = key, n, context, total, kinds
        self.rest = -log10(max(1, SYMBOLS - len(self.grams[0].mixed)))

    def scores(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probabilities of symbols behind contexts of ``order`` bytes."""
        k = self.order
        gram, own = self.grams[k].find((context << 9) | symbol), self.contexts[k].find(context)
        out = self.grams[k].take(0, gram) - self.contexts[k].take(0, own)
        todo = np.flatnonzero(gram < 0)
        context, symbol, own = context[todo], symbol[todo], own[todo]
        spent = self.contexts[k].take(1, own)
        while len(todo) and k:
            k -= 1
            longer, context = own, context & ((1 << 8 * k) - 1)
            gram, own = self.grams[k].find((context << 9) | symbol), self.contexts[k].find(context)
            above = longer >= 0
            norm = np.where(above, self.contexts[k + 1].take(2, longer), self.contexts[k].take(0, own))
            escape = np.where(above, self.contexts[k + 1].take(3, longer), self.contexts[k].take(1, own))
            hit = gram >= 0
            out[todo[hit]] = spent[hit] + self.grams[k].take(0, gram[hit]) - norm[hit]
            spent = (spent + escape)[~hit]
            todo, context, symbol, own = todo[~hit], context[~hit], symbol[~hit], own[~hit]
        out[todo] = spent + self.rest
        return out


class AdaptivePPM:
    """Plain PPM over a trie of dictionaries: learns while it reads. Also the model the tables are tested against."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(lambda: defaultdict(int))

    def probability(self, history: bytes, symbol: int) -> float:
        left, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            seen = {s: c for s, c in self.counts.get(history[len(history) - k :], {}).items() if s not in excluded}
            if not seen:
                continue
            norm = sum(seen.values()) + len(seen)
            if symbol in seen:
                return left * seen[symbol] / norm
            left *= len(seen) / norm
            excluded |= seen.keys()
        return left / (SYMBOLS - len(excluded))

    def learn(self, history: bytes, symbol: int, n: int = 1) -> None:
        for k in range(self.order + 1):
            self.counts[history[len(history) - k :]][symbol] += n

    def score(self, text: str | None, learn: bool = True) -> float:
        """log10 probability of a text; with ``learn`` every symbol is counted once it is predicted."""
        tokens = (text or "").encode().lower().split()
        stream = [*b"".join(w + b" " for w in tokens), END]
        history, total = b" " * self.order, 0.0
        for s in stream:
            total += log10(self.probability(history, s))
            if learn:
                self.learn(history, s)
            history = (history + bytes([s & 0xFF]))[-self.order :]
        return total

    def train(self, text: str | None) -> None:
        history = b" " * self.order
        for s in [*b"".join(w + b" " for w in (text or "").encode().lower().split()), END]:
            self.learn(history, s)
            history = (history + bytes([s & 0xFF]))[-self.order :]


# -- distributed steps --------------------------------------------------------


_GRAMS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("size", pa.int64())])


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)


def _count_grams(buckets: int):
    """Counts of (context, symbol) over a task's training texts, as blobs by bucket."""

    def flush(keys, counts):
        key, n = _merge(keys, counts)
        bucket = ((mix(key.astype(U64)) >> U64(48)).astype(np.int64) * buckets) >> 16
        order = np.argsort(bucket, kind="stable")  # keys stay sorted within a bucket
        key, n = key[order], n[order]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
        cut = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())
        yield pa.record_batch([pa.array(some, pa.int32()), cut(key), cut(n), pa.array([int(cuts[i + 1] - cuts[i]) for i in some], pa.int64())], schema=_GRAMS)

    def run(batches):
        keys, counts, held = [], [], 0
        for t in batches:
            t = t.filter(t.column("train"))
            for _, _, symbols, scored, *_ in sequences(t.column("text")):
                key = np.sort(((contexts(symbols) << 9) | symbols)[scored])
                if not len(key):
                    continue
                start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                keys.append(key[start])
                counts.append(np.diff(np.concatenate((start, [len(key)]))))
                held += len(start)
                if held > 4_000_000:
                    key, n = _merge(keys, counts)
                    keys, counts, held = [key], [n], len(key)
                    if held > 2_000_000:
                        yield from flush(keys, counts)
                        keys, counts, held = [], [], 0
        if held:
            yield from flush(keys, counts)

    return run


def _sum_grams(table: pa.Table) -> pa.Table:
    """One row: the summed counts of a bucket."""
    get = lambda name: [np.frombuffer(x, np.int64) for x in table.column(name).to_pylist()]
    key, n = _merge(get("keys"), get("counts"))
    return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([key.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([len(key)])], schema=_GRAMS)


def _shorten(order: int):
    """The pairs of a lower order that a task's blobs hold, each with its blob's bucket."""
    mask = (1 << (8 * order + 9)) - 1

    def run(batches):
        for t in batches:
            keys, counts, size = [], [], []
            for k, n in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True):
                key, n = _merge([np.frombuffer(k, np.int64) & mask], [np.frombuffer(n, np.int64)])
                keys.append(key.tobytes())
                counts.append(n.tobytes())
                size.append(len(key))
            yield pa.record_batch([t.column("bucket"), pa.array(keys, pa.binary()), pa.array(counts, pa.binary()), pa.array(size, pa.int64())], schema=_GRAMS)

    return run


def _rebucket(buckets: int):
    def run(batches):
        for t in batches:
            for k, n in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True):
                key, n = np.frombuffer(k, np.int64), np.frombuffer(n, np.int64)
                bucket = ((mix(key.astype(U64)) >> U64(48)).astype(np.int64) * buckets) >> 16
                for i in np.unique(bucket).tolist():
                    at = bucket == i
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([key[at].tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary()), pa.array([int(at.sum())])], schema=_GRAMS)

    return run


def _suffix_sizes(batches):
    """How many pairs a task's blobs have behind each two last bytes of the context."""
    total = np.zeros(1 << 16, np.int64)
    for t in batches:
        for k in t.column("keys").to_pylist():
            total += np.bincount(np.frombuffer(k, np.int64) >> 9 & 0xFFFF, minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.record_batch({"suffix": pa.array(some.astype(np.int32)), "size": pa.array(total[some])})


def _blocks(sizes: dict[int, int], most: int) -> tuple[np.ndarray, int]:
    """The block of each suffix, and how many blocks: each has at most ``most`` pairs or is a single suffix."""
    block, n, held = np.zeros(1 << 16, np.int32), 0, 0
    for suffix, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if held and held + size > most:
            n, held = n + 1, 0
        block[suffix] = n
        held += size
    return block, n + 1


def _split_blocks(block: np.ndarray):
    """Blobs cut by block."""

    def run(batches):
        for t in batches:
            for k, n in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True):
                key, n = np.frombuffer(k, np.int64), np.frombuffer(n, np.int64)
                to = block[key >> 9 & 0xFFFF]
                for i in np.unique(to).tolist():
                    at = to == i
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([key[at].tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary()), pa.array([int(at.sum())])], schema=_GRAMS)

    return run


_WORD_BLOBS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *((x, pa.binary()) for x in ("low", "high", "rows", "row", "tf", "text", "copies"))])


def _send_words(buckets: int):
    """Blobs of (word, texts it occurs in, occurrences) by bucket of the word's hash."""

    def flush(task, number, hashes, owner, keys, copies):
        h, d = np.concatenate(hashes), np.concatenate(owner)
        order = np.argsort(h, kind="stable")  # texts stay in order within a word
        h, d = h[order], d[order]
        pair = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
        tf = np.diff(np.concatenate((pair, [len(h)]))).astype(np.uint32)
        h, d = h[pair], d[pair]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        rows = np.diff(np.concatenate((first, [len(h)]))).astype(np.uint32)
        word = h[first]
        bucket = ((word >> U64(48)).astype(np.int64) * buckets) >> 16
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        ends = np.concatenate((first, [len(h)]))
        keys, copies = np.array(keys, np.int64), np.array(copies, np.uint32)
        out = defaultdict(list)
        for i in range(buckets):
            lo, hi = cuts[i], cuts[i + 1]
            if lo == hi:
                continue
            p, q = ends[lo], ends[hi]
            present, local = np.unique(d[p:q], return_inverse=True)
            w = word[lo:hi]
            for name, x in (
                ("low", (w & U64(0xFFFFFFFF)).astype(np.uint32)), ("high", (w >> U64(32)).astype(np.uint32)), ("rows", rows[lo:hi]),
                ("row", local.astype(np.uint16)), ("tf", tf[p:q]), ("text", keys[present]), ("copies", copies[present]),
            ):
                out[name].append(x.tobytes())
            out["bucket"].append(i)
            out["batch"].append((task << 32) | number)
            if len(out["bucket"]) == 64:
                yield pa.record_batch([pa.array(out[f.name], f.type) for f in _WORD_BLOBS], schema=_WORD_BLOBS)
                out = defaultdict(list)
        if out:
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in _WORD_BLOBS], schema=_WORD_BLOBS)

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        hashes, owner, keys, copies, place, held = [], [], [], [], {}, 0
        for t in batches:
            train = t.column("train").to_numpy(zero_copy_only=False).astype(bool)
            offsets, raw = texts(t.column("text"))
            for a, b in slices(offsets):
                lo, hi = int(offsets[a]), int(offsets[b])
                buf = LOWER[raw[lo:hi]]
                s, e, firsts = words(buf, offsets[a : b + 1] - lo)
                h = span_hashes(buf, s, e)
                for i, key in enumerate(text_keys(h, firsts).tolist()):
                    at = place.get(key)
                    if at is None:
                        place[key] = at = len(keys)
                        keys.append(key)
                        copies.append(0)
                        x = h[firsts[i] : firsts[i + 1]]
                        hashes.append(x)
                        owner.append(np.full(len(x), at, np.int32))
                        held += len(x)
                    copies[at] += int(train[a + i])
                if held > FLUSH_WORDS or len(keys) > FLUSH_TEXTS - 2000:
                    if held:
                        yield from flush(task, number, hashes, owner, keys, copies)
                    number += 1
                    hashes, owner, keys, copies, place, held = [], [], [], [], {}, 0
        if held:
            yield from flush(task, number, hashes, owner, keys, copies)

    return run


_WORD_SUMS = pa.schema([("batch", pa.int64()), ("text", pa.binary()), ("known", pa.binary()), ("logs", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def _sum_words(table: pa.Table) -> pa.Table:
    """Counts of a bucket's words, and what they give each text of each batch."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    word = (np.concatenate(get("high", np.uint32)).astype(U64) << U64(32)) | np.concatenate(get("low", np.uint32))
    _, kind = np.unique(word, return_inverse=True)
    rows, row, tf, text, copies = (get(n, k) for n, k in (("rows", np.uint32), ("row", np.uint16), ("tf", np.uint32), ("text", np.int64), ("copies", np.uint32)))
    count = np.zeros(int(kind.max()) + 1)
    at = 0
    spans = []
    for r, d, f, c in zip(rows, row, tf, copies, strict=True):
        k = np.repeat(kind[at : at + len(r)], r)
        spans.append(k)
        count += np.bincount(k, f * c[d].astype(np.float64), len(count))
        at += len(r)
    value = np.log10(count + 0.5)
    out = defaultdict(list)
    for k, d, f, t in zip(spans, row, tf, text, strict=True):
        out["text"].append(t.tobytes())
        out["known"].append(np.bincount(d, f * (count[k] > 0), len(t)).astype(np.int64).tobytes())
        out["logs"].append(np.bincount(d, f * value[k], len(t)).tobytes())
    n = len(spans)
    return pa.table(
        [table.column("batch").combine_chunks(), *(pa.array(out[x], pa.binary()) for x in ("text", "known", "logs")), pa.array([int(count.sum())] + [0] * (n - 1)), pa.array([int((count > 0).sum())] + [0] * (n - 1))],
        schema=_WORD_SUMS,
    )


def _sum_texts(table: pa.Table) -> pa.Table:
    """The partial sums of one batch, added by text."""
    get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    key, at = np.unique(get("text", np.int64), return_inverse=True)
    known = np.bincount(at, get("known", np.int64), len(key)).astype(np.int64)
    return pa.table({"key": pa.array(key), "known": pa.array(known), "logs": pa.array(np.bincount(at, get("logs", np.float64), len(key)))})


_TABLES: dict[str, Model] = {}


def _score(name: str, model, adaptive: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches):
        if adaptive:
            for t in batches:
                keys, n = [], []
                for _, _, _, _, _, hashes, firsts in sequences(t.column("text")):
                    keys.append(text_keys(hashes, firsts))
                    n.append(np.diff(firsts) + 1)
                score = [AdaptivePPM().score(x) for x in t.column("text").to_pylist()]
                yield pa.record_batch([t.column("doc_id"), t.column("train"), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(np.concatenate([np.zeros(0, np.int64), *n])), pa.array(score, pa.float64())], schema=schema)
            return
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = Model(*model.value)
        tables = _TABLES[name]
        for t in batches:
            keys, n, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, symbols, scored, start, hashes, firsts in sequences(t.column("text")):
                lp = np.zeros(len(symbols))
                lp[scored] = tables.scores(contexts(symbols)[scored] & ((1 << 8 * tables.order) - 1), symbols[scored].astype(np.int64))
                score.append(np.add.reduceat(lp, start[:-1]))
                keys.append(text_keys(hashes, firsts))
                n.append(np.diff(firsts) + 1)
            yield pa.record_batch([t.column("doc_id"), t.column("train"), *(pa.array(np.concatenate(x)) for x in (keys, n, score))], schema=schema)

    return run


def _score_block(name: str, model, block: np.ndarray, number: int):
    """Key and partial score of each text: the symbols behind contexts of one block."""

    def run(batches):
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = Model(*model.value)
        tables = _TABLES[name]
        for t in batches:
            for _, _, symbols, scored, start, hashes, firsts in sequences(t.column("text")):
                context = contexts(symbols)
                at = np.flatnonzero(scored & (block[context & 0xFFFF] == number))
                lp = np.zeros(len(symbols))
                lp[at] = tables.scores(context[at], symbols[at].astype(np.int64))
                yield pa.record_batch({"key": pa.array(text_keys(hashes, firsts)), "part": pa.array(np.add.reduceat(lp, start[:-1]))})

    return run


def _count_tokens(batches):
    """Row, key and number of tokens; the score comes from the blocks."""
    for t in batches:
        keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, _, _, _, hashes, firsts in sequences(t.column("text")):
            keys.append(text_keys(hashes, firsts))
            n.append(np.diff(firsts) + 1)
        yield pa.record_batch({"doc_id": t.column("doc_id"), "train": t.column("train"), "key": pa.array(np.concatenate(keys)), "n_tokens": pa.array(np.concatenate(n))})


def _numbers(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all blobs."""
    fits = counts.select("keys", "counts").toArrow()
    return tuple(np.frombuffer(b"".join(fits.column(i).to_pylist()), np.int64) for i in (0, 1))


def _block_scores(rows: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """(key, score) of every text by the trie of order ``ORDER``, one block of it in memory at a time."""
    spark = rows.sparkSession
    sizes = counts.mapInArrow(_suffix_sizes, "suffix int, size long").groupBy("suffix").agg(F.sum("size"))
    block, n = _blocks(dict(map(tuple, sizes.collect())), MAX_GRAMS)
    base = counts.mapInArrow(_shorten(1), kind).mapInArrow(_rebucket(GRAM_BUCKETS), kind).groupBy("bucket").applyInArrow(lambda t: _sum_grams(t), kind)
    base = _numbers(base)
    cut = shared_table(counts.mapInArrow(_split_blocks(block), kind), "ppm-blocks")
    parts = None
    for i in range(n):
        model = spark.sparkContext.broadcast((ORDER, *_numbers(cut.filter(F.col("bucket") == i)), base))
        part = rows.select("text").mapInArrow(_score_block(uuid.uuid4().hex, model, block, i), "key long, part double")
        # Equal texts have equal parts.
        part = shared_table(part.groupBy("key").agg(F.max("part").alias("part")), "ppm-part")
        model.destroy()
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("key").agg(F.sum("part").alias("score"))


def _fitting(counts: DataFrame, kind: str):
    """(order, keys, counts) of the highest order that has at most ``MAX_GRAMS`` pairs."""
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            # The bucket of a shorter pair differs from that of the longer one: count distinct pairs per new bucket.
            counts = shared_table(
                counts.mapInArrow(_shorten(order), kind)
                .mapInArrow(_rebucket(GRAM_BUCKETS), kind)
                .groupBy("bucket")
                .applyInArrow(lambda t: _sum_grams(t), kind),
                "ppm-grams",
            )
        if order == 1 or (counts.agg(F.sum("size")).first()[0] or 0) <= MAX_GRAMS:
            break
    return (order, *_numbers(counts))


def ppm_scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", mode: str = "pretrained") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``train`` is a boolean column: the rows to learn from. ``mode`` is pretrained, whole or adaptive.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model, name, by_block = None, uuid.uuid4().hex, None
    if mode in ("pretrained", "whole"):
        kind = "bucket int, keys binary, counts binary, size long"
        counts = rows.select("train", "text").mapInArrow(_count_grams(GRAM_BUCKETS), kind).groupBy("bucket").applyInArrow(lambda t: _sum_grams(t), kind)
        counts = shared_table(counts, "ppm-grams")
        if mode == "whole" and (counts.agg(F.sum("size")).first()[0] or 0) > MAX_GRAMS:
            by_block = _block_scores(rows, counts, kind)
        else:
            model = spark.sparkContext.broadcast(_fitting(counts, kind))
    if by_block is None:
        scored = rows.mapInArrow(_score(name, model, mode == "adaptive"), "doc_id long, train boolean, key long, n_tokens long, score double")
    else:
        scored = rows.mapInArrow(_count_tokens, "doc_id long, train boolean, key long, n_tokens long")
    scored = shared_table(scored, "ppm-scored")

    size = scored.agg(F.sum("n_tokens"), F.count_if("train")).first()
    buckets = int(min(4096, max(32, (size[0] or 0) / BUCKET_WORDS)))
    blobs = rows.select("train", "text").mapInArrow(_send_words(buckets), ", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'long' if f.name == 'batch' else 'binary'}" for f in _WORD_BLOBS))
    sums = blobs.groupBy("bucket").applyInArrow(lambda t: _sum_words(t), "batch long, text binary, known binary, logs binary, tokens long, types long")
    sums = shared_table(sums, "ppm-words")
    total = sums.agg(F.sum("tokens"), F.sum("types")).first()
    ends = size[1] or 0
    n, v = (total[0] or 0) + ends, (total[1] or 0) + (ends > 0)
    per_text = sums.groupBy("batch").applyInArrow(lambda t: _sum_texts(t), "key long, known long, logs double")
    per_text = per_text.groupBy("key").agg(F.max("known").alias("known"), F.max("logs").alias("logs"))
    copies = scored.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    per_text = copies.join(per_text, "key", "left")
    if by_block is not None:
        per_text = per_text.join(by_block, "key", "left")
    per_text = shared_table(per_text, "ppm-texts")
    out = join_groups(scored, per_text, "key", "copies")
    norm, end_log = log10(n + 0.5 * (v + 1)), log10(ends + 0.5)
    return out.select(
        "doc_id", "train", "n_tokens",
        (F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.coalesce("logs", F.lit(0.0)) + end_log - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )


def op2_ppm_scores(spark, sf_dir: str) -> DataFrame:
    """PPM and unigram scores over the whole of ``documents``; rows with crc32(doc_id) mod 5 = 1 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = ppm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, mode="whole")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
