"""Connected components of a link table, kept in DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over ``links``, for every linked node.

    Each round takes the smallest label among the neighbours and then the label's
    own label, so that a chain shortens by more than half; rounds end when no
    label changes. Only minima are aggregated: a hub with many links is combined
    before the shuffle, and its join is one that Spark splits. Self-links and
    repeated links change nothing; an empty table gives no rows.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    labels = both.groupBy("src").agg(F.min(F.least("src", "dst")).alias("label")) \
        .withColumnRenamed("src", "node").checkpoint()
    while True:
        near = (both.join(labels, both["dst"] == labels["node"])
                .groupBy("src").agg(F.min("label").alias("near")).withColumnRenamed("src", "node"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                 F.least("label", "near").alias("label"))
        lower = lower.checkpoint()
        ahead = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = lower.join(ahead, "label").select("node", "old", F.least("label", "next").alias("label")).checkpoint()
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
