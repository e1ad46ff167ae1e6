"""Connected components of a table of edges, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label (the smallest node reachable) for every node of edges (a, b).

    Each round takes the smallest label of the neighbours and then the label's own
    label, so distances halve. Partial aggregation and splittable joins bear a node
    with very many neighbours; nothing is gathered.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = scratch.save(both.distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = step.join(further, "label").select("node", F.least("label", "far").alias("label"), "old")
        k += 1
        labels = scratch.save(jumped, f"{name}-{k}")
        if not labels.where("label <> old").take(1):
            scratch.drop(*(f"{name}-{i}" for i in range(k)), f"{name}-edges")
            return labels.select("node", "label")
        labels = labels.select("node", "label")
