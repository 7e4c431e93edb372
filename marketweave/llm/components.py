"""Connected components of a link table, in Spark, with lineage cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import spool


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) links -> (node, label) for every node with a link; label is the smallest node.

    Every round contracts the links to labels, hooks each label to its smallest neighbour and
    follows the hooks twice; no round gathers a component anywhere.
    """
    links = spool(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("label"))
    edges = links
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        hooks = spool(hooks.where("a <> to"), "hooks")
        for _ in range(2):
            up = hooks.select(F.col("a").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(up, "to", "left").select("a", F.coalesce("further", "to").alias("to"))
        hooks = spool(hooks, "hooks")
        moved = hooks.select(F.col("a").alias("label"), F.col("to"))
        labels = spool(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        here, there = hooks.select("a", F.col("to").alias("ta")), hooks.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(here, "a", "left").join(there, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        edges = spool(edges.where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components: no end after {max_rounds} rounds")
