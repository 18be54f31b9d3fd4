"""A filter of fixed size for keys of a later exact step, in DataFrame functions only.

Keys hash to ``BITS`` bits, kept as at most ``BITS / 32768`` rows of 4 KB: 4 MB
however many keys there are. That bound makes the broadcast safe at any scale.
The filter only lets too much through (it fills up as keys grow), never too little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def _slot(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS)) + 1


def build(keys: DataFrame, *key: Column | str) -> DataFrame:
    """Rows ``(_part, _bits)`` of the filter over ``keys``."""
    slot = _slot(*key)
    return (
        keys.select(F.bitmap_bucket_number(slot).alias("_part"), F.bitmap_bit_position(slot).alias("_at"))
        .groupBy("_part")
        .agg(F.bitmap_construct_agg("_at").alias("_bits"))
    )


def probe(rows: DataFrame, bits: DataFrame, *key: Column | str, flag: str = "_may") -> DataFrame:
    """``rows`` with boolean ``flag``: false only for keys that are not in the filter."""
    slot = _slot(*key)
    at = F.bitmap_bit_position(slot)
    marked = rows.withColumns({"_part": F.bitmap_bucket_number(slot), "_at": at}).join(F.broadcast(bits), "_part", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("1") == F.when(F.col("_bits").isNull(), 0).otherwise(
        (F.floor(byte / F.pow(F.lit(2), F.pmod(F.col("_at"), F.lit(8)))) % 2).cast("int")
    )
    return marked.withColumn(flag, hit).drop("_part", "_at", "_bits")
