"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of byte n-grams (n = 1 to ``SPECTRUM``,
letters lower-cased, other characters as one space) present in both, over the
geometric mean of how many each has. A bounded sample of labelled rows is drawn;
``LANDMARKS`` of them, dealt evenly over the languages, span the Nyström feature
space: the features of a text are its kernel values with the landmarks times the
inverse root of the landmarks' own kernel matrix. One-versus-rest kernel ridge
regression is then a ridge regression in that space, solved in closed form on
the sample. Scoring multiplies batches of texts' n-gram presence matrices with
the landmarks' presence matrix and the result with the regression weights; both
have a fixed size whatever the corpus.

The sample: of each language, the ``PER_LANGUAGE`` training rows with the
smallest hash of text and id among texts of at most ``SAMPLE_BYTES`` bytes. It
bounds what the classifier is fitted on; every row of the table is scored, on its whole text.

Cases: a null text, or one without any letter, is ``und`` with score 0. Ties go
to the language first in alphabetical order. Rows that repeat are scored each.
Null languages never train. With no training rows every text is ``und``. An
empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.textkit import U64, mix
from strandline.runtime import ship

SPECTRUM = 4
LANDMARKS = 240
#: The sample: rows a language, rows in all, and bytes of a text that can be drawn. At most 80 MB reach the driver.
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_BYTES = 300, 2400, 1 << 15
RIDGE = 1e-3
#: Texts multiplied at a time; a batch's presence matrix has this many rows.
BATCH = 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True


def clean(text: str | None) -> bytes:
    """Lower case; everything but letters becomes one space; a space at both ends."""
    raw = (text or "").lower().encode("utf-8", "replace")
    buf = np.frombuffer(raw, np.uint8)
    buf = np.where(_LETTER[buf], buf, 0x20)
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != 0x20) | (buf[:-1] != 0x20)
    return b" " + buf[keep].astype(np.uint8).tobytes().strip() + b" "


def has_letter(text: str | None) -> bool:
    return text is not None and (text.isalpha() or any(map(str.isalpha, text)))


def grams(cleaned: bytes) -> np.ndarray:
    """Distinct n-grams of 1 to ``SPECTRUM`` bytes as numbers (the length is in the high bits)."""
    b = np.frombuffer(cleaned, np.uint8).astype(np.int64)
    out = []
    code = np.zeros(len(b), np.int64)
    for n in range(1, SPECTRUM + 1):
        code = (code[: len(b) - n + 1] << 8) | b[n - 1 :] if n > 1 else b
        if not len(code):
            break
        x = np.sort(code)
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] | (n << 40))
    return np.concatenate(out)


class Model:
    """Landmarks' presence matrix, and weights from kernel values to one score a language."""

    def __init__(self, texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted(set(languages))
        sets = [grams(clean(t)) for t in texts]
        turn = {lang: [i for i, x in enumerate(languages) if x == lang] for lang in self.languages}
        each = max(1, landmarks // max(1, len(turn)))
        chosen = [i for lang in self.languages for i in turn[lang][:each]]
        self.columns = np.unique(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
        index = _Columns(self.columns)
        self.index = index
        marks = index.presence([sets[i] for i in chosen])
        self.marks = (marks / np.sqrt([max(1, len(sets[i])) for i in chosen])[:, None]).astype(np.float32).T.copy()
        if not chosen:
            return
        size = np.array([max(1, len(s)) for s in sets])
        k = np.concatenate([index.presence(sets[at : at + BATCH]) @ self.marks for at in range(0, len(sets), BATCH)]).astype(np.float64) / np.sqrt(size)[:, None]
        own = k[chosen]
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        good = values > 1e-6 * values.max()  # equal landmarks leave null directions
        root = vectors[:, good] / np.sqrt(values[good]) @ vectors[:, good].T  # inverse root of the landmarks' kernel
        z = np.column_stack((k @ root, np.ones(len(k))))
        y = np.where(np.array(languages)[:, None] == np.array(self.languages), 1.0, -1.0)
        w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ y)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        size = np.sqrt([max(1, len(s)) for s in sets]).astype(np.float32)[:, None]
        return (self.index.presence(sets) @ self.marks) / size @ self.weights + self.bias


class _Columns:
    """Column of an n-gram: its own for the landmarks' n-grams, none for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, 2 + len(keys).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        at = self.place(keys)
        order = np.argsort(at, kind="stable")
        at_sorted = at[order]
        first = np.concatenate(([True], at_sorted[1:] != at_sorted[:-1])) if len(at) else np.zeros(0, bool)
        self.slot[at_sorted[first]] = order[first]
        self.rest = np.sort(keys[order[~first]])
        self.rest_column = np.searchsorted(keys, self.rest)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self.place(keys)]
        out = np.where((at >= 0) & (self.keys[np.maximum(at, 0)] == keys), at, -1) if len(self.keys) else np.full(len(keys), -1)
        if len(self.rest):
            miss = np.flatnonzero((out < 0) & (at >= 0))
            p = np.minimum(np.searchsorted(self.rest, keys[miss]), len(self.rest) - 1)
            hit = self.rest[p] == keys[miss]
            out[miss[hit]] = self.rest_column[p[hit]]
        return out

    def presence(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.keys)), np.float32)
        if sets:
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            column = self.find(np.concatenate(sets))
            hit = column >= 0
            out[row[hit], column[hit]] = 1
        return out


_MODELS: dict[str, Model] = {}


def _predict(name: str, shared):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Model(*shared.value)
        model = _MODELS[name]
        for t in batches:
            texts = t.column("text")
            langs, scores = [], []
            for at in range(0, len(t), BATCH):
                part = texts.slice(at, BATCH).to_pylist()
                known = [i for i, x in enumerate(part) if model.languages and has_letter(x)]
                lang, score = ["und"] * len(part), [0.0] * len(part)
                if known:
                    margin = model.margins([grams(clean(part[i])) for i in known])
                    best = margin.argmax(1)
                    for i, b, m in zip(known, best.tolist(), margin.max(1).tolist(), strict=True):
                        lang[i], score[i] = model.languages[b], min(1.0, max(0.0, (m + 1) / 2))
                langs += lang
                scores += score
            yield pa.record_batch([t.column("doc_id"), t.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return run


def identify(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; ``held_out`` is a boolean column of rows not to learn from."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    training = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    training = training.withColumn("rank", F.xxhash64("text", "doc_id"))
    languages = training.select("lang").distinct().count()
    each = max(1, min(per_language, SAMPLE_ROWS // max(1, languages)))
    # Hashes first: the window keeps a few rows a language in every task before it shuffles. Then their texts.
    order = Window.partitionBy("lang").orderBy("rank", "doc_id")
    least = training.select("lang", "rank", "doc_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("lang", "rank", "doc_id")
    chosen = training.join(F.broadcast(least), ["lang", "rank", "doc_id"], "left_semi").select("text", "lang", "rank", "doc_id").distinct()
    got = sorted(chosen.collect(), key=lambda r: (r["lang"], r["rank"], r["doc_id"]))
    model = spark.sparkContext.broadcast(([r["text"] for r in got], [r["lang"] for r in got]))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(uuid.uuid4().hex, model), "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all of ``documents``; rows with crc32(doc_id) mod 4 = 2 are held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
