"""The driver's tables and small literal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, sql: str) -> DataFrame:
    """Rows of a VALUES clause, which the SQL counterpart repeats word for word."""
    return spark.sql(sql)
