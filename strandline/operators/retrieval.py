"""The retrieval legs and their fusion, batched over questions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.terms import Terms, terms
from strandline.functions.text import covers
from strandline.functions.vocab import (
    ANSWER_THRESHOLD, BM25_B, BM25_K1, CAVEAT_THRESHOLD, CONFIDENCE_WEIGHTS, DEFAULT_INTENT, GATE_CEILING, INTENT_RULES, INTENT_WEIGHTS, NO_GRAPH,
    RELEVANCE_FLOOR, RRF_K, SUB_QUESTION_DISCOUNT,
)
from strandline.runtime import drop_shared, shared_table, ship, slices


# -- lexical ------------------------------------------------------------------


_LISTED = pa.schema([("length", pa.int64()), ("terms", pa.list_(pa.string())), ("tf", pa.list_(pa.int64()))])


def _listed(only: set[str] | None):
    def run(batches):
        of = Terms()
        for t in slices(batches, 1):
            length, names, counts = [], [], []
            for text in t.column(1):
                words = of(text.as_py())
                length.append(len(words))
                n = Counter(words if only is None else [w for w in words if w in only])
                names.append(list(n.keys()))
                counts.append(list(n.values()))
            yield pa.RecordBatch.from_arrays([t.column(0), *(pa.array(x, f.type) for x, f in zip((length, names, counts), _LISTED, strict=True))], names=["id", "length", "terms", "tf"])

    return run


def listed(docs: DataFrame, id_col: str, text_col: str, only: list[str] | None = None) -> DataFrame:
    """(id, length, terms, tf): one row a text, from one walk over it. With ``only``, other terms are counted in the length and not listed."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_listed(None if only is None else set(only)), f"id {rows.schema['id'].dataType.simpleString()}, length long, terms array<string>, tf array<long>")


def postings(docs: DataFrame, id_col: str, text_col: str, only: list[str] | None = None) -> DataFrame:
    """(id, term, tf, length). A text is one row, so terms need no shuffle at all."""
    return _postings(listed(docs, id_col, text_col, only))


def _postings(lists: DataFrame) -> DataFrame:
    each = lists.select("id", "length", F.explode(F.arrays_zip("terms", "tf")).alias("x"))
    return each.select("id", F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"), "length")


def _stats(lists: DataFrame) -> DataFrame:
    return lists.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("tokens")).withColumn(
        "avgdl", F.round(F.col("tokens") / F.greatest(F.col("chunks"), F.lit(1)), 2)
    )


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: number of texts, index terms, and average length, none below zero."""
    return _stats(listed(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text", []))


#: Folders of a stored index; a question reads those of its terms.
INDEX_BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Postings by bucket of the term, and one row of corpus figures, below ``path``. Common terms are dealt over several files."""
    lists = shared_table(listed(docs, id_col, text_col), "index-lists")
    rows = _postings(lists).withColumn("bucket", _bucket(F.col("term")))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    _stats(lists).write.parquet(f"{path}/stats")
    drop_shared(lists)


def bm25(docs: DataFrame, id_col: str, text_col: str, questions: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B, allowed: Column | None = None) -> DataFrame:
    """(qid, id, score, matched_terms, rank) of the best ``k`` texts of each question.

    ``questions`` is a small stated set (qid, question); its distinct terms are
    fetched so that the one walk over the texts keeps only postings that some question
    asks for. Document frequencies count all texts, also those that ``allowed`` rules out.
    """
    asked = shared_table(questions.select("qid", F.explode(F.array_distinct(terms(F.col("question")))).alias("term")), "asked")
    wanted = sorted(r["term"] for r in asked.select("term").distinct().collect())
    lists = shared_table(listed(docs, id_col, text_col, wanted), "lists")
    among = None if allowed is None else docs.filter(allowed).select(F.col(id_col).alias("id"))
    return _ranked(_postings(lists), _stats(lists), asked, k, k1, b, among)


def bm25_indexed(spark, path: str, questions: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Like ``bm25`` from a stored index: only the folders of the questions' terms are read, and no text."""
    asked = shared_table(questions.select("qid", F.explode(F.array_distinct(terms(F.col("question")))).alias("term")), "asked")
    found = asked.select("term", _bucket(F.col("term")).alias("bucket")).distinct().collect()
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin([r["bucket"] for r in found]) & F.col("term").isin([r["term"] for r in found]))
    return _ranked(hits.select("id", "term", "tf", "length"), spark.read.parquet(f"{path}/stats"), asked, k, k1, b)


def _ranked(hits: DataFrame, stats: DataFrame, asked: DataFrame, k: int, k1: float, b: float, among: DataFrame | None = None) -> DataFrame:
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = stats.select(F.greatest("chunks", F.lit(1)).alias("n"), F.greatest(F.col("tokens") / F.greatest("chunks", F.lit(1)), F.lit(1.0)).alias("avg"))
    if among is not None:
        hits = hits.join(among, "id", "left_semi")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg")))
    scored = (
        hits.join(F.broadcast(df), "term")  # one row a question term
        .join(F.broadcast(asked), "term")
        .join(F.broadcast(stats))  # one row
        .groupBy("qid", "id")
        .agg(F.sum(part).alias("score"), F.count("term").alias("matched_terms"))
    )
    return top(scored, ["qid"], [F.round("score", 9).desc(), F.col("id")], k)


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark cuts groups to ``k`` before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def document_frequencies(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(term, df) for every wanted term, 0 where no text has it."""
    have = [r["term"] for r in wanted.select("term").distinct().collect()]
    df = postings(docs, id_col, text_col, have).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return wanted.select("term").distinct().join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def unknown_terms(docs: DataFrame, id_col: str, text_col: str, questions: DataFrame) -> DataFrame:
    """(qid, unknown): capitalised words of four letters or more whose terms occur in no text, sorted."""
    words = questions.select("qid", F.explode(F.regexp_extract_all("question", F.lit(r"\b([A-Z][a-z]{3,})\b"), 1)).alias("surface"))
    words = words.withColumn("term", F.get(terms(F.col("surface")), 0)).filter("term is not null")
    have = [r["term"] for r in words.select("term").distinct().collect()]
    known = postings(docs, id_col, text_col, have).select("term").distinct()
    return words.join(F.broadcast(known), "term", "left_anti").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("unknown"))


# -- dense --------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null if a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): exact cosine against a stated, broadcast set of query vectors (qid, vector)."""
    scored = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).join(F.broadcast(queries.select("qid", "vector")))
    scored = scored.select("qid", "id", F.round(cosine(F.col("v"), F.col("vector")), 9).alias("score")).filter("score is not null")
    return top(scored, ["qid"], [F.col("score").desc(), F.col("id")], k)


#: Vectors of one side that meet those of the other at once.
VECTOR_BLOCK = 2048
_BLOCK = "ids binary, groups binary, vectors binary, dim int"
_NO_ID = np.iinfo(np.int64).min


def _vector_blocks(batches):
    """(ids, groups, unit vectors, dimension) by up to ``VECTOR_BLOCK`` rows of one dimension; what has no cosine is left out."""
    for t in batches:
        ids, groups = (t.column(i).fill_null(_NO_ID).to_numpy() for i in ("id", "g"))
        by_dim = {}
        for i, v in enumerate(t.column("v").to_pylist()):
            if v and None not in v:
                by_dim.setdefault(len(v), []).append((i, v))
        for dim, some in by_dim.items():
            at, v = np.array([i for i, _ in some]), np.array([v for _, v in some], np.float64)
            norm = np.sqrt((v * v).sum(1))
            at, v = at[norm != 0], v[norm != 0] / norm[norm != 0, None]
            for a in range(0, len(at), VECTOR_BLOCK):
                cut = slice(a, a + VECTOR_BLOCK)
                yield pa.record_batch({"ids": pa.array([ids[at[cut]].tobytes()]), "groups": pa.array([groups[at[cut]].tobytes()]), "vectors": pa.array([v[cut].tobytes()]), "dim": pa.array([dim], pa.int32())})


def _meet(answer):
    """What ``answer`` makes of the cosines of each pair of blocks, by query."""

    def run(batches):
        for t in batches:
            for r in t.to_pylist():
                if r["dim"] != r["q_dim"]:
                    continue
                ids, groups, qids = (np.frombuffer(r[x], np.int64) for x in ("ids", "groups", "q_ids"))
                v, q = (np.frombuffer(r[x], np.float64).reshape(-1, r["dim"]) for x in ("vectors", "q_vectors"))
                scores = q @ v.T
                for a in range(len(qids)):
                    key, score = answer(ids, groups, scores[a])
                    yield pa.record_batch({"qid": pa.array(np.full(len(key), qids[a])), "key": pa.array(key), "score": pa.array(score)})

    return run


def _meetings(vectors: DataFrame, id_col: str, vector_col: str, group: Column, queries: DataFrame, answer) -> DataFrame:
    ship(vectors.sparkSession)
    # Stored, since each block is read once for each of the other side's partitions.
    kind = lambda rows: shared_table(rows.mapInArrow(_vector_blocks, _BLOCK), "vector-blocks")
    all_ = kind(vectors.select(F.col(id_col).cast("long").alias("id"), group.cast("long").alias("g"), F.col(vector_col).alias("v")))
    asked = kind(queries.select(F.col("qid").cast("long").alias("id"), F.lit(0).cast("long").alias("g"), F.col("vector").alias("v")))
    # Dimensions are compared where blocks meet: a join on them would send everything to one task.
    pairs = all_.crossJoin(asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("dim").alias("q_dim")))
    out = pairs.mapInArrow(_meet(answer), "qid long, key long, score double")
    return out.withColumn("key", F.when(F.col("key") != int(_NO_ID), F.col("key")))


def dense_blocks(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int) -> DataFrame:
    """``dense`` for any number of queries: blocks of queries meet blocks of rows, and a meeting gives ``k`` rows a query at most."""

    def best(ids, groups, score):
        score = np.round(score, 9) + 0.0
        first = np.lexsort((ids, -np.where(np.isnan(score), np.inf, score)))[:k]
        return ids[first], score[first]

    found = _meetings(vectors, id_col, vector_col, F.lit(0), queries, best).withColumnRenamed("key", "id")
    return top(found, ["qid"], [F.col("score").desc(), F.col("id")], k)


def best_per_group_blocks(vectors: DataFrame, id_col: str, vector_col: str, group_col: str, queries: DataFrame) -> DataFrame:
    """(qid, group, best): the largest cosine of each query in each group, by blocks as in ``dense_blocks``."""

    def best(ids, groups, score):
        order = np.argsort(groups, kind="stable")
        start = np.flatnonzero(np.diff(groups[order], prepend=groups[order[:1]] - 1))
        return groups[order][start], np.maximum.reduceat(score[order], start)

    found = _meetings(vectors, id_col, vector_col, F.col(group_col), queries, best).withColumnRenamed("key", group_col)
    return found.groupBy("qid", group_col).agg(F.max("score").alias("best"))


# -- fusion -------------------------------------------------------------------


def leg_weight(leg: Column, intent: Column) -> Column:
    """Weight of a leg for an intent; ``name:sub<n>`` legs count at a discount."""
    table = F.create_map(*(x for i, legs in INTENT_WEIGHTS.items() for leg_, w in legs.items() for x in (F.lit(f"{i}/{leg_}"), F.lit(w))))
    base = F.substring_index(leg, ":", 1)
    return F.coalesce(F.try_element_at(table, F.concat(intent, F.lit("/"), base)), F.lit(1.0)) * F.when(leg.contains(":sub"), SUB_QUESTION_DISCOUNT).otherwise(1.0)


def fuse(legs: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (qid, leg, id, rank, weight)."""
    fused = legs.groupBy("qid", "id").agg(
        F.sum(F.col("weight") / (constant + F.col("rank"))).alias("score"),
        F.countDistinct("leg").alias("n_legs"),
        F.min("rank").alias("best_rank"),
        F.array_join(F.array_sort(F.collect_set(F.substring_index("leg", ":", 1))), "+").alias("retrievers"),
    )
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("n_legs").desc(), F.col("best_rank"), F.col("id"))
    out = fused.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


# -- questions ----------------------------------------------------------------


def intent(question: Column) -> Column:
    """struct(intent, confidence) by the first rule that matches."""
    out = None
    for name, sure, pattern in INTENT_RULES:
        value = F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"))
        out = F.when(question.rlike(pattern), value) if out is None else out.when(question.rlike(pattern), value)
    return out.otherwise(F.struct(F.lit(DEFAULT_INTENT[0]).alias("intent"), F.lit(DEFAULT_INTENT[1]).alias("confidence")))


def relevance(question_terms: Column, answer_terms: Column, idf: Column) -> Column:
    """Share of the question's idf weight that the answer covers; ``idf`` is a map term -> weight."""
    weight = lambda t: F.coalesce(F.try_element_at(idf, t), F.lit(1.0))
    total = F.aggregate(question_terms, F.lit(0.0), lambda s, t: s + weight(t))
    covered = F.filter(question_terms, lambda t: F.exists(answer_terms, lambda a: covers(t, a)))
    return F.when(total == 0, 1.0).otherwise(F.aggregate(covered, F.lit(0.0), lambda s, t: s + weight(t)) / total)


def idf_weight(df: Column, most: Column) -> Column:
    return F.when(df.isNull(), 1.0).when(df == 0, 4.0).otherwise(F.least(F.lit(4.0), 1 + F.log((most + 1) / df)))


def confidence(
    top_score: Column, scale: Column, documents: Column, systems: Column, verified: Column, claims: Column, relevance: Column, current: Column, total: Column,
    graph_facts: Column, missing: Column, unknown: Column, live: Column, answerer: Column,
) -> Column:
    """struct(score, mode, gate): six weighted signals under four gates."""
    strength = F.when(top_score <= 0, 0.0).when(scale == "reranker", F.least(F.lit(1.0), top_score)).otherwise(F.least(F.lit(1.0), top_score / (top_score + 4.0) * 2.0))
    several = F.least(F.lit(1.0), 0.4 + 0.2 * (documents - 1))
    agreement = F.when(documents <= 0, 0.0).when(documents == 1, 0.25).otherwise(F.when(systems > 1, F.least(F.lit(1.0), several + 0.2)).otherwise(several))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    signals = {
        "retrieval_strength": strength, "claim_coverage": ratio(verified, claims), "answer_relevance": relevance, "source_agreement": agreement,
        "currency": ratio(current, total), "graph_support": F.when(graph_facts > 0, 1.0).otherwise(NO_GRAPH),
    }
    plain = sum((F.lit(CONFIDENCE_WEIGHTS[n]) * F.bround(c.cast("double"), 4) for n, c in signals.items()), F.lit(0.0))
    gate = F.when(missing, "unknown_asset").when(relevance < RELEVANCE_FLOOR, "answer_off_topic").when(unknown, "unknown_term").when(live, "live_state_unavailable")
    capped = F.when(gate.isNotNull(), F.least(plain, F.lit(GATE_CEILING))).otherwise(plain)
    mode = F.when(~answerer, "abstain_no_answer").when(capped >= ANSWER_THRESHOLD, "answer").when(capped >= CAVEAT_THRESHOLD, "answer_with_caveat").otherwise("abstain_and_route")
    return F.struct(F.round(capped, 4).alias("score"), mode.alias("mode"), gate.alias("gate"))


def diverse(scored: Column, similarity, most: int = 4, limit: float = 0.6) -> Column:
    """Greedy choice over an array sorted best first: skip what is too like a chosen one, stop at ``most``."""
    empty = F.slice(scored, 1, 0)
    return F.aggregate(
        scored, empty, lambda kept, x: F.when((F.size(kept) >= most) | F.exists(kept, lambda y: similarity(x, y) > limit), kept).otherwise(F.concat(kept, F.array(x)))
    )
