"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import removed, stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b: long) reaches.

    Labels start as the nodes themselves. Each round takes the least label among a node's
    own and its neighbours', then the label of that label (which halves the distance still to
    go), until nothing changes. Every round is written to the shared folder; nothing but a
    count reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = stored(lower.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        changed = after.where("old <> label").limit(1).count()
        removed(labels)
        labels = after.select("node", "label")
        if not changed:
            removed(both)
            return labels
