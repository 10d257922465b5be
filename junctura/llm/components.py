"""Connected components of an edge table, by hooking labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node of edges (a, b), both long.

    Each round takes the least label over every edge, for its ends and for the labels they had, and then the label of
    the label; labels only fall, and rounds end when none does. Nodes may have any number of edges: the minimum is
    combined before the shuffle, and joins have one row a node on one side."""
    e = staged(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node"), F.least("a", "b").alias("label"))
    labels = staged(nodes.groupBy("node").agg(F.min("label").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        la, lb = labels.withColumnsRenamed({"node": "a", "label": "la"}), labels.withColumnsRenamed({"node": "b", "label": "lb"})
        met = e.join(la, "a").join(lb, "b").filter("la <> lb")
        low = F.least("la", "lb")
        hooks = met.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), low.alias("label"))
        lowered = hooks.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        up = staged(lowered, "lowered")
        parents = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = up.join(parents, "label").select("node", F.col("next").alias("label"))
        after = staged(jumped, "labels")
        # a round without a change of the sum has changed nothing, as labels only fall
        before_sum, after_sum = (x.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0] for x in (labels, after))
        discard(up, labels)
        labels = after
        if before_sum == after_sum:
            discard(e)
            return labels.withColumnRenamed("label", "component")
