"""Connected components as Spark jobs, for links that near-duplicate operators find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .store import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Every round takes the smallest label among a node's neighbours and then the
    label of that label, so a chain of n links needs about log n rounds.  Rounds
    are written tables; labels are joined and minimised, never gathered.
    """
    one = links.where(f"{a} <> {b}").select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["node"] == near["x"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        to = labels.select(F.col("node").alias("t"), F.col("component").alias("u"))
        moved = low.join(to, low["c"] == to["t"], "left").select("node", "old", F.least("c", F.coalesce("u", "c")).alias("component"))
        seen = Observation()
        labels = written(moved.observe(seen, F.count(F.when(F.col("old") != F.col("component"), 1)).alias("changed")).select("node", "component"), "labels")
        if not seen.get["changed"]:
            return labels
