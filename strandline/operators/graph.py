"""Property-graph operators on node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.vocab import MAX_HOPS


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both ends."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def khop(edges: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(anchor, node, distance) within ``hops`` undirected steps (1 to 3) of each anchor.

    Breadth first: a round joins the newest frontier with the edges and keeps nodes
    not reached before, so each node is expanded once an anchor.
    """
    both = undirected(edges.select("src", "dst")).distinct()
    seen = anchors.select(F.col("node").alias("anchor"), "node").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for step in range(1, max(1, min(MAX_HOPS, hops)) + 1):
        reached = frontier.join(both, F.col("node") == F.col("src")).select("anchor", F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select("anchor", "node"), ["anchor", "node"], "left_anti").withColumn("distance", F.lit(step))
        seen = seen.unionByName(frontier)
    return seen


def selected(edges: DataFrame, wanted: list[str], allowed: list[str]) -> DataFrame:
    """Edges of the wanted types that are allowed; all allowed ones if none is."""
    both = [t for t in wanted if t in allowed] or allowed
    return edges.filter(F.col("type").isin(both))


def valid_on(edges: DataFrame, day) -> DataFrame:
    """Edges valid on a day; a missing bound is always valid, both ends count."""
    return edges.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))


def anchors_found(wanted: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, found) of every wanted anchor."""
    return wanted.join(nodes.select(key).distinct().withColumn("_found", F.lit(True)), key, "left").select(key, F.coalesce("_found", F.lit(False)).alias("found"))


def counts_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


def adjacent_pairs(levels: DataFrame, series: str, id_col: str) -> DataFrame:
    """(newer, older) of every two rows on neighbouring levels of a series."""
    older = levels.select(F.col(series).alias("_s"), (F.col("level") + 1).alias("_next"), F.col(id_col).alias("older"))
    return levels.join(older, (F.col(series) == F.col("_s")) & (F.col("level") == F.col("_next"))).select(series, F.col(id_col).alias("newer"), "older")


def merge_nodes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: a new value wins where it is not null, other values stay."""
    columns = [c for c in old.columns if c != key]
    theirs = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return old.join(theirs, key, "full").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in columns))
