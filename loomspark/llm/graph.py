"""Connected components by distributed label passing; no link or label comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import drop_stored, store


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes in links (a, b); label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then follows the label of that label, so a chain shrinks
    by more than half a round.  Labels are written to the shared folder after each round.
    """
    both = store(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "links")
    labels = store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("l")).select(F.col("a").alias("node"), "l")
        met = labels.join(near, "node").select("node", F.least("label", "l").alias("l"), F.col("label").alias("old"))
        # A label is a node itself; its own label is at most as large.
        up = labels.select(F.col("node").alias("l"), F.col("label").alias("further"))
        new = store(met.join(up, "l", "left").select("node", F.least("l", F.coalesce("further", "l")).alias("label"), "old"), "labels")
        changed = not new.filter("label != old").isEmpty()
        drop_stored(links.sparkSession, labels)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError("labels still change; raise most_rounds")
    drop_stored(links.sparkSession, both)
    return labels.select("node", "label")
