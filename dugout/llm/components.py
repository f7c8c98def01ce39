"""Connected components of a link table, by alternating star operations.

Each round writes its links to the shared folder, so a lost executor costs a task and the
lineage stays short. A hub with many links is reduced by map-side minima before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.sources.shared import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Point neighbours at the smallest node around: the larger neighbours, or the smaller ones.

    ``edges`` has a > b in every row. Large step: every neighbour above a node joins that node's
    smallest neighbour. Small step: every neighbour below it, and the node itself, does.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node that has a link; the component is its smallest node.

    Runs until a round changes nothing: links are then stars around the smallest nodes.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), "edges"
    )
    while True:
        new = materialize(_star(materialize(_star(edges, True), "edges"), False), "edges")
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        edges = new
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
