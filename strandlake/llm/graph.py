"""Connected components of a link table, by hanging nodes on smaller neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of the links (a, b).

    Each round hangs every node on its smallest neighbour, if that is smaller, follows these parents to their roots by
    doubling, and puts the roots in the links' places. Links inside a tree vanish, so later rounds see few. All steps are
    joins and minimum aggregations on checkpointed tables. Links with a null end are ignored; no links give no nodes.
    """
    ends = links.where("a is not null and b is not null").select(F.least("a", "b").alias("_u"), F.greatest("a", "b").alias("_v"))
    edges = checkpointed(ends.distinct())
    labels = None
    while True:
        both = edges.select(F.col("_u").alias("node"), F.col("_v").alias("near")).union(edges.select("_v", "_u"))
        parents = checkpointed(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")))
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            parents = checkpointed(parents.join(above, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")))
            if parents.where("moved").isEmpty():
                break
            parents = parents.select("node", "root")
        parents = parents.select("node", "root")
        if labels is None:
            labels = parents.select("node", F.col("root").alias("component"))
        else:
            higher = parents.select(F.col("node").alias("component"), "root")
            labels = checkpointed(labels.join(higher, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        left = edges.join(parents.select(F.col("node").alias("_u"), F.col("root").alias("_ru")), "_u")
        right = left.join(parents.select(F.col("node").alias("_v"), F.col("root").alias("_rv")), "_v").where("_ru <> _rv")
        edges = checkpointed(right.select(F.least("_ru", "_rv").alias("_u"), F.greatest("_ru", "_rv").alias("_v")).distinct())
        if edges.isEmpty():
            return labels
