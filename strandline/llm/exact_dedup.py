"""Exact de-duplication by progressive refinement, in DataFrame functions only.

Three keys of rising cost split the rows: length in bytes, then length and a
hash of the first bytes, then length and SHA-256 of the whole text. A group with
one row is final and goes no further. The first two keys come from one narrow
scan; which groups survive travels to the second scan as a bitmap of fixed size
(``bitmap``), so no text is ever shuffled and only texts of surviving groups are
hashed whole.

Cases: a null text counts as empty, so all null and empty texts are one group.
Rows that repeat a doc_id stand and fall together: they count in group_size and
all carry kept = true if that id is the largest of its group. A null id never
beats another; in a group of null ids alone all rows stay. An empty table gives
an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bitmap
from strandline.runtime import join_groups, shared_table

PREFIX_BYTES = 64


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = PREFIX_BYTES, digests: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (binary).

    ``digest`` is null for rows that an earlier key already singled out, unless
    ``digests`` asks for it on every row.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
        "doc_id", "_text", F.octet_length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, prefix_bytes)).alias("_head")
    )
    by_head = keyed.groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("_n"))
    surviving = by_head.filter(F.col("_n") > 1)
    seen = bitmap.probe(keyed, bitmap.build(surviving, "_len", "_head"), "_len", "_head")
    full = F.sha2("_text", 256)
    hashed = seen.select(
        "doc_id",
        F.when(F.col("_may"), F.unhex(full)).alias("_full"),
        (F.unhex(full) if digests else F.when(F.col("_may"), F.unhex(full))).alias("digest"),
    )
    hashed = shared_table(hashed, "dedup-rows")
    groups = hashed.filter(F.col("_full").isNotNull()).groupBy("_full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = shared_table(groups, "dedup-groups")
    out = join_groups(hashed, groups, "_full", "group_size", "left")
    return out.select(
        "doc_id",
        F.when(F.col("_full").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_full").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The operator over the whole of ``documents``, with every row's SHA-256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_duplicates(docs, digests=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
