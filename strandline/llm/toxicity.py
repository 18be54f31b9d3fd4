"""Toxicity by a chain of classifiers.

Categories are predicted one after another. Each link is a logistic regression on
the presence of words and word stems, and on the probabilities of all earlier
categories. While training, those probabilities are out of fold: the sample is cut
into folds, and a row's probability comes from a model that has not seen the row.
So a later link learns how far it can trust an earlier one. For prediction every
link is fitted once more on the whole sample.

A feature is a run of letters and digits (A-Z lower-cased), or the first five bytes
of a longer run; a text has it or not, however long the text. Each link keeps the
``FEATURES`` features with the largest chi-squared value against its category. The
decision threshold on the last category maximises F1 over out-of-fold probabilities.

The sample is bounded by ``PER_CLASS``: of the labelled doc_ids with the last category,
and of those without, the ``PER_CLASS`` with the smallest hash of doc_id are drawn, and
of the rows that carry a drawn doc_id again at most ``PER_CLASS`` of either class, by the
same order; weights restore the classes' shares. Texts longer than ``SAMPLE_BYTES`` do
not enter the sample. Rows that share the smallest shingle hash with an earlier row are
near copies and train once, as do rows equal in doc_id and text. Every row of the table
is scored on its whole text.

Features of the sample are made and counted on the executors and stay there. The
driver receives, however large the tables are, the sample's row keys, the keys of the
chosen features, and one bit for each chosen feature and row: ``2 * PER_CLASS`` rows of
``FEATURES * (FOLDS + 1)`` bits a category (5 MB with two categories). Newton steps sum
their Gram matrices over blocks of ``BLOCK`` rows.

The labelled categories of the given tables are low quality (quality = 0) and toxic,
in this order; any list of 0/1 label columns can be chained.

Cases: null and empty texts have no features and get the base rates. Several labels
of one doc_id count as their maximum; labels without a row, and null labels, are
left out. With no labelled rows, or one class only, the category's probability is
its smoothed share everywhere and nothing is toxic. A probability equal to the
threshold is flagged; features of equal value are taken in the order of their hashes.
Rows that repeat are scored each. An empty table gives an empty result. Further columns stay as they are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.jaccard_join import shingle_sets
from strandline.llm.textkit import LOWER, U64, slices, span_hashes, texts, thrifty
from strandline.runtime import drop_shared, shared_table, ship

STEM_BYTES = 5
FEATURES = 512
#: The sample: labelled rows of either class of the last category, and bytes of a text in it.
PER_CLASS, SAMPLE_BYTES = 5000, 1 << 15
FOLDS = 3
RIDGE = 0.3
LEAST_ROWS = 3
#: Texts whose features a worker holds at a time.
TEXTS = 256
#: Sample rows that a Newton step holds as floating-point numbers at a time.
BLOCK = 1024

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def features(column):
    """For slices of a column: (a, b, feature hashes, text of each)."""
    offsets, raw = texts(column)
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        buf = LOWER[raw[lo:hi]]
        cuts = offsets[a : b + 1] - lo
        word = _WORD[buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = cuts[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(cuts, s, "right") - 1
        long = e - s > STEM_BYTES
        whole = span_hashes(buf, s, e)
        stem = span_hashes(buf, s[long], s[long] + STEM_BYTES) ^ U64(0x9E3779B97F4A7C15)
        yield a, b, np.concatenate((whole, stem)), np.concatenate((doc, doc[long]))


def presence(column, keys: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1: which of the sorted ``keys`` each text has."""
    out = np.zeros((len(column), len(keys)), np.float32)
    if not len(keys):
        return out
    maybe = np.zeros(1 << 18, bool)
    maybe[(keys >> U64(46)).astype(np.int64)] = True
    for a, _, h, doc in features(column):
        some = np.flatnonzero(maybe[(h >> U64(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
        hit = keys[at] == h[some]
        out[a + doc[some[hit]], at[hit]] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the bias last, of a ridge logistic regression by Newton steps over blocks of rows."""
    wide = x.shape[1] + 1
    b = np.zeros(wide)
    penalty = np.full(wide, ridge)
    penalty[-1] = 1e-6
    for _ in range(12):
        slope, gram = -penalty * b, np.diag(penalty)
        for at in range(0, len(x), BLOCK):
            part = np.column_stack((x[at : at + BLOCK], np.ones(len(x[at : at + BLOCK])))).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ b, -30, 30)))
            v = w[at : at + BLOCK]
            slope += part.T @ (v * (y[at : at + BLOCK] - p))
            # the matrix only steers the steps, so single precision will do
            half = part.astype(np.float32)
            gram += half.T @ (half * (v * np.maximum(p * (1 - p), 1e-5))[:, None].astype(np.float32))
        step = np.linalg.solve(gram, slope)
        b += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return b


def probability(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))


class Chain:
    """Links of a chain: per category sorted feature keys and weights (features, earlier categories, bias); a threshold on the last."""

    def __init__(self, links: list[tuple[np.ndarray, np.ndarray]], threshold: float):
        self.links, self.threshold = links, threshold

    def predict(self, column) -> np.ndarray:
        """Probabilities of every category, in order, for every text of a column."""
        done = np.zeros((len(column), 0))
        for keys, b in self.links:
            done = np.column_stack((done, probability(np.column_stack((presence(column, keys), done)), b)))
        return done


class Sample:
    """What the driver knows of the sample: labels, weights and folds of its rows, and bits of chosen features."""

    def __init__(self, y: np.ndarray, w: np.ndarray, folds: int = FOLDS):
        self.y, self.w, self.folds = y.astype(float), w, folds
        self.fold = np.arange(len(y)) % folds
        self.keys = np.zeros(0, U64)
        self.bits = np.zeros((len(y), 0), np.uint8)

    def varies(self, c: int) -> bool:
        return len(self.y) >= 2 * self.folds and 0 < self.y[:, c].sum() < len(self.y)

    def matrix(self, keys: np.ndarray, rows: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Features ``keys`` and earlier probabilities of the rows with ``rows`` set."""
        at = np.searchsorted(self.keys, keys)
        x = np.empty((int(rows.sum()), len(keys) + earlier.shape[1]), np.float32)
        x[:, : len(keys)] = (self.bits[rows][:, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        x[:, len(keys) :] = earlier[rows]
        return x

    def chain(self, chosen: dict[tuple[int, int], np.ndarray]) -> Chain:
        """Fit the links; ``chosen[c, f]`` are the features of category c without fold f, -1 standing for none left out."""
        n, many = self.y.shape
        y, w, links, earlier = self.y, self.w, [], np.zeros((n, 0))
        everyone = np.ones(n, bool)
        for c in range(many):
            target = y[:, c]
            if not self.varies(c):
                share = (float((w * target).sum()) + 0.5) / (float(w.sum()) + 1)
                links.append((np.zeros(0, U64), np.concatenate((np.zeros(c), [np.log(share / (1 - share))]))))
                earlier = np.column_stack((earlier, np.full(n, share)))
                continue
            out = np.zeros(n)
            for f in range(self.folds):
                train, rest, k = self.fold != f, self.fold == f, chosen[c, f]
                out[rest] = probability(self.matrix(k, rest, earlier), logistic(self.matrix(k, train, earlier), target[train], w[train]))
            k = chosen[c, -1]
            links.append((k, logistic(self.matrix(k, everyone, earlier), target, w)))
            earlier = np.column_stack((earlier, out))
        return Chain(links, threshold(earlier[:, -1], y[:, -1], w) if n and 0 < y[:, -1].sum() < n else 2.0)


def threshold(p: np.ndarray, t: np.ndarray, w: np.ndarray) -> float:
    """The probability from which flagging has the largest weighted F1."""
    order = np.argsort(-p, kind="stable")
    right, taken = np.cumsum((w * t)[order]), np.cumsum(w[order])
    f1 = 2 * right / (taken + (w * t).sum())
    best = int(f1.argmax())
    taken_last, first_left = p[order][best], p[order][best + 1] if best + 1 < len(p) else 0.0
    share = (w * t).sum() / w.sum()
    # midway between the last taken and the first left, and not far below the base rate that a small sample may suggest
    return float(np.clip((taken_last + first_left) / 2, share / 4, 0.9))


_DRAWN = pa.schema([("key", pa.int64()), ("features", pa.binary()), ("near", pa.int64())])


def _described(batches):
    """Distinct feature hashes and the smallest shingle hash of every sample text."""
    for t in (b.slice(at, TEXTS) for b in batches for at in range(0, len(b), TEXTS)):
        column = t.column("text")
        found = [np.zeros(0, U64)] * len(t)
        for a, b, h, doc in features(column):
            order = np.argsort(doc, kind="stable")
            h, cuts = h[order], np.searchsorted(doc[order], np.arange(b - a + 1))
            for i in range(b - a):
                found[a + i] = np.unique(h[cuts[i] : cuts[i + 1]])
        near = [None] * len(t)
        for i, x in shingle_sets(column):
            near[i] = int(x.min().view(np.int64)) if len(x) else None
        yield pa.record_batch([t.column("key"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(near, pa.int64())], schema=_DRAWN)


def _counted(cells: int):
    """(feature, rows of each cell with it) over the rows of a task; a cell is a fold and a set of labels."""
    schema = pa.schema([("feature", pa.int64()), *((f"n{i}", pa.int64()) for i in range(cells))])

    def run(batches):
        for t in (b.slice(at, TEXTS) for b in batches for at in range(0, len(b), TEXTS)):
            blobs = [np.frombuffer(x.as_buffer(), np.int64) for x in t.column("features")]
            key = np.concatenate([np.zeros(0, np.int64), *blobs])
            cell = np.repeat(t.column("cell").to_numpy(zero_copy_only=False), [len(x) for x in blobs]).astype(np.int64)
            kinds, at = np.unique(key, return_inverse=True)
            n = np.bincount(at * cells + cell, minlength=len(kinds) * cells).reshape(len(kinds), cells)
            for lo in range(0, len(kinds), 1 << 14):
                part = n[lo : lo + (1 << 14)]
                yield pa.record_batch([pa.array(kinds[lo : lo + (1 << 14)]), *(pa.array(part[:, i]) for i in range(cells))], schema=schema)

    return run


def _bits_of(keys: np.ndarray):
    schema = pa.schema([("key", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for t in batches:
            bits = [np.packbits(np.isin(keys, np.frombuffer(x.as_buffer(), U64), assume_unique=True)).tobytes() for x in t.column("features")]
            yield pa.record_batch([t.column("key"), pa.array(bits, pa.binary())], schema=schema)

    return run


def _best(features_: DataFrame, s: Sample, cells: list[tuple[int, int]], weight: dict[int, float], c: int, left_out: int) -> DataFrame:
    """The ``FEATURES`` features with the largest chi-squared value against category ``c`` on all folds but one."""
    fit = s.fold != left_out
    n, p = float(s.w[fit].sum()), float((s.w * s.y[:, c])[fit].sum())
    used = [(f"n{i}", bool(label >> c & 1), weight[label >> (s.y.shape[1] - 1) & 1]) for i, (fold, label) in enumerate(cells) if fold != left_out]
    add = lambda columns: reduce(Column.__add__, columns, F.lit(0))
    rows = add([F.col(x) for x, _, _ in used])
    total = add([F.col(x) * F.lit(v) for x, _, v in used])
    both = add([F.col(x) * F.lit(v) for x, yes, v in used if yes])
    expected = total * (p / n)
    spread = F.greatest(expected * (1 - p / n) * (1 - total / n), F.lit(1e-9))
    value = F.when(rows >= LEAST_ROWS, F.pow(both - expected, 2) / spread)
    best = features_.select("feature", value.alias("value")).filter("value > 0").orderBy(F.desc("value"), "feature").limit(FEATURES)
    return best.select(F.lit(c).alias("c"), F.lit(left_out).alias("f"), "feature")


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Chain:
    """A chain over ``categories`` (name -> 0/1 column of ``labels``, in order), fitted on the bounded sample."""
    spark = docs.sparkSession
    ship(spark)
    many = len(categories)
    known = labels.select(F.col(id_col).alias("id"), *(c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values()))).dropna()
    known = known.groupBy("id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(many)))
    label = reduce(Column.__add__, [F.when(F.col(f"y{i}") != 0, 1 << i).otherwise(0) for i in range(many)])
    known = known.select("id", label.alias("label"), F.xxhash64("id").alias("rank"))
    toxic = F.col("label") >= 1 << many - 1
    counts = {bool(r[0]): r[1] for r in known.groupBy(toxic).count().collect()}

    def first(rows: DataFrame, *order: str) -> DataFrame:
        return rows.filter(~toxic).orderBy(*order).limit(per_class).unionByName(rows.filter(toxic).orderBy(*order).limit(per_class))

    drawn = shared_table(first(known, "rank", "id"), "toxicity-ids")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    rows = rows.join(F.broadcast(drawn), "id").withColumn("key", F.xxhash64("id", "text"))
    chosen = first(rows.select("rank", "id", "key", "label").distinct(), "rank", "id", "key")
    chosen = shared_table(chosen.select("rank", "id", "key", "label"), "toxicity-keys")
    # a drawn doc_id may hold a third of all rows, but of equal ones only the first gets through each task
    texts_ = rows.join(F.broadcast(chosen.select("key")), "key", "left_semi").select("key", "text").mapInArrow(thrifty(_described), "key long, features binary, near long")
    sample = shared_table(texts_.groupBy("key").agg(F.first("features").alias("features"), F.first("near").alias("near")), "toxicity-sample")

    got = chosen.join(sample.select("key", "near"), "key").select("rank", "id", "key", "label", "near").orderBy("rank", "id", "key").collect()
    size = {k: sum((r["label"] >> many - 1) == k for r in got) for k in (0, 1)}
    base = sum(counts.values()) / max(1, len(got))
    weight = {k: counts.get(bool(k), 0) / max(1, size[k]) / max(base, 1e-9) for k in (0, 1)}
    seen, kept = set(), []
    for r in got:
        if r["near"] is None or r["near"] not in seen:
            kept.append(r)
        seen.add(r["near"])
    y = np.array([[r["label"] >> i & 1 for i in range(many)] for r in kept]).reshape(len(kept), many)
    s = Sample(y, np.array([weight[r["label"] >> many - 1] for r in kept]))
    if not any(s.varies(c) for c in range(many)):
        return s.chain({})

    cells = sorted({(int(f), r["label"]) for f, r in zip(s.fold, kept, strict=True)})
    number = {x: i for i, x in enumerate(cells)}
    place = spark.createDataFrame([(r["key"], number[int(f), r["label"]]) for f, r in zip(s.fold, kept, strict=True)], "key long, cell int")
    train = sample.select("key", "features").join(F.broadcast(place), "key")
    names = [f"n{i}" for i in range(len(cells))]
    tallies = train.select("features", "cell").mapInArrow(thrifty(_counted(len(cells))), "feature long, " + ", ".join(f"{x} long" for x in names))
    tallies = shared_table(tallies.groupBy("feature").agg(*(F.sum(x).alias(x) for x in names)), "toxicity-features")
    wanted = [(c, f) for c in range(many) if s.varies(c) for f in (-1, *range(s.folds))]
    best: dict[tuple[int, int], list[int]] = {x: [] for x in wanted}
    for r in reduce(DataFrame.unionByName, [_best(tallies, s, cells, weight, c, f) for c, f in wanted]).collect():
        best[r["c"], r["f"]].append(r["feature"])
    picked = {x: np.sort(np.array(v, np.int64).view(U64)) for x, v in best.items()}
    s.keys = np.unique(np.concatenate([np.zeros(0, U64), *picked.values()]))
    bits = dict(train.select("key", "features").mapInArrow(thrifty(_bits_of(s.keys)), "key long, bits binary").collect())
    s.bits = np.array([np.frombuffer(bits[r["key"]], np.uint8) for r in kept]).reshape(len(kept), -1)
    chain = s.chain(picked)
    for spent in (drawn, chosen, sample, tallies):
        drop_shared(spent)
    return chain


def _annotate(shared, at: int, schema: pa.Schema | None = None):
    def run(batches):
        chain = None
        for t in batches:
            if chain is None:
                chain = shared.value
            column = t.column(at)
            # a dense block of rows at a time
            parts = [chain.predict(column.slice(lo, 2048)) for lo in range(0, len(t), 2048)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(chain.links)))
            columns = [pa.array(p[:, c]) for c in range(p.shape[1])] + [pa.array(p[:, -1] >= chain.threshold, pa.bool_())]
            names = [f"_p{c}" for c in range(p.shape[1])] + ["_flag"]
            yield pa.RecordBatch.from_arrays([*t.columns, *columns], names=[*(f"c{i}" for i in range(t.num_columns)), *names])

    return run


def annotate(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with array ``_p`` of the chain's probabilities and boolean ``_flag``; clashing names are no matter inside."""
    spark = docs.sparkSession
    ship(spark)
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    renamed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    many = len(chain.links)
    schema = StructType([*renamed.schema.fields, *(StructField(f"_p{c}", DoubleType()) for c in range(many)), StructField("_flag", BooleanType())])
    out = renamed.mapInArrow(thrifty(_annotate(spark.sparkContext.broadcast(chain), docs.columns.index(text_col))), schema)
    probabilities = F.array(*(F.col(f"_p{c}") for c in range(many)))
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)), probabilities.alias("_p"), "_flag")


def default_categories() -> dict[str, Column]:
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Chain probabilities and the toxic flag of all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), default_categories())
    out = annotate(docs, chain)
    return out.select("doc_id", F.col("_p")[0].alias("p_low_quality"), F.col("_p")[1].alias("p_toxic"), F.col("_flag").alias("toxic"))
