"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.session import stash


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node of it) of every node of ``edges`` (``a``, ``b``).

    Each round a tree hooks onto the least label of its neighbours and every node jumps to its root's root, so that
    the number of rounds grows with the logarithm of the longest path. Labels are written to the shared folder each
    round. Null ends and loops are no edges; nodes without edges do not appear.
    """
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    pairs = stash(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stash(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = pairs.join(labels, pairs["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        seen = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        hooked = seen.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("hook"))
        lower = seen.join(hooked, seen["label"] == hooked["root"]).select("node", F.col("label").alias("old"), F.least("low", "hook").alias("label"))
        jump = lower.select(F.col("node").alias("root"), F.col("label").alias("next"))
        moved = lower.join(jump, lower["label"] == jump["root"], "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        moved = stash(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
