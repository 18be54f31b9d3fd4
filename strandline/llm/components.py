"""Connected components of a graph given as links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import shared_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of ``links``; label is the smallest node reachable.

    Every round takes the smallest label among a node and its neighbours and then
    the label of that label (pointer jumping), so rounds grow with the logarithm
    of a chain's length. Sums per node are pre-aggregated before the shuffle; the
    join on a node with very many links is between two plain exchanges, which AQE splits.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("next")).union(links.select(F.col(b), F.col(a)))
    both = shared_table(both.filter("node <> next").distinct(), "cc-links")
    first = both.groupBy("node").agg(F.min("next").alias("least"))
    labels = shared_table(first.select("node", F.least("node", "least").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "next", "label": "theirs"}), "next").groupBy("node").agg(F.min("theirs").alias("theirs"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        stepped = shared_table(stepped, "cc-step")
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = shared_table(
            stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "cc-labels"
        )
        if not new.filter("old <> label").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
