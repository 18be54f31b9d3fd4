"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Toxic documents go, one of each group of equal texts stays, one document of each
near-duplicate component stays, documents that hold a benchmark item go, and the
rest are packed into sequences.

Decisions are taken on rows, not on ids: a row is told from all others by its place in
the stored input, so a row that repeats a doc_id with a text of its own is judged by
that text. Of equal texts the largest doc_id stays, of near copies the smallest; a null
id only if the group has no other, and of rows equal in both the one with the smallest
hash of its place in the input.

Cases: null and empty texts are equal to each other, so one of all such rows passes the
exact dedup; they are linked with nothing else, hold no item and are one token. Rows
repeated whole leave one. An empty table passes every stage as an empty table. Columns
of any name besides doc_id and text pass all filtering stages as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bitmap, decontaminate, toxicity
from strandline.llm.exact_dedup import exact_duplicates
from strandline.llm.jaccard_join import jaccard_components
from strandline.llm.packing import packed_documents
from strandline.runtime import shared_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxic flag is not set. The chain is fitted on labelled rows of ``documents`` that are still there."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.default_categories())
    return toxicity.annotate(docs, chain).filter("not _flag").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest doc_id."""
    docs, at = _placed(docs)
    key = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), -at)
    copies = exact_duplicates(docs.select(key.alias("id"), F.col("text").alias("text")), id_col="id")
    return _without(docs, key, copies.filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts one row stays, that with the smallest doc_id."""
    docs, at = _placed(docs)
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), at)
    linked = jaccard_components(docs.select(key.alias("id"), F.col("text").alias("text")), id_col="id")
    return _without(docs, key, linked.filter("doc_id <> component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining texts with their places in sequences of 4096 tokens."""
    return packed_documents(docs)


def _placed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` as a stored table, and a column that tells its rows apart by their place in it."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    if "_metadata" not in docs.columns:
        try:
            docs.select(place)
            return docs, place
        except AnalysisException:  # not read from files
            pass
    names = docs.columns
    stored = shared_table(docs.toDF(*(f"c{i}" for i in range(len(names)))), "placed")
    stored = stored.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n != "_metadata"), place.alias("_place"), *(F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n == "_metadata"))
    return stored, F.col("_place")


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not among the doc_id of ``dropped``.

    Only rows that a bitmap of fixed size can't clear take part in the join, so the
    texts that stay are hardly shuffled.
    """
    columns = [c for c in docs.columns if c != "_place"]
    dropped = shared_table(dropped.select(F.col("doc_id").alias("key")), "dropped")
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("key"))
    marked = bitmap.probe(rows, bitmap.build(dropped, "key"), "key")
    unsure = marked.filter("_may").join(dropped, "key", "left_anti")
    return marked.filter("not _may").select("row.*").unionByName(unsure.select("row.*"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: Toxicity is a fitted model, so SQL can't express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
