"""Connected components by alternating large-star and small-star.

Large-star links each node's larger neighbours to the least node it knows; small-star links a node and its smaller
neighbours to the least of them.  Repeated until nothing changes, every node hangs from the least node of its component.
The rounds end when the edges are stars. Each round only aggregates minima and joins them back, so a hub costs one combined row for each task, and no component
meets in one task.  The edges of a round are written to the shared folder; the driver sees whether one node is left to move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.shared import discard, materialise


#: Edges to a writing task.
EDGES = 250_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # larger neighbours of each node, to the node's minimum
    larger = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("a"))
    return larger.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges that point from larger to smaller nodes."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _by_node(edges: DataFrame) -> DataFrame:
    """For each node its least and greatest parent and whether it is one; one exchange of combined rows."""
    up = edges.select(F.col("a").alias("node"), F.col("b").alias("parent"), F.lit(False).alias("root"))
    down = edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("root"))
    return up.unionByName(down).groupBy("node").agg(F.min("parent").alias("least"), F.max("parent").alias("most"), F.bool_or("root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of the ``(a, b)`` edges; a component's name is its least node.

    Loops and repeated edges do no harm; an edge with a null end is left out; no edges give an empty result. Edges that already form
    stars need no more than one round.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b AND a IS NOT NULL AND b IS NOT NULL")
    # files and writing tasks follow the number of edges, which no round raises by more than its nodes
    parts = max(1, -(-now.count() // EDGES))
    before = None
    while True:
        large = materialise(_large_star(now).coalesce(parts), "large-star")
        now = materialise(_small_star(large).coalesce(parts), "small-star")
        discard(large, before)
        before = now
        nodes = _by_node(now)
        # all stars: every child has one parent, and no parent is a child
        if nodes.where("least <> most OR (root AND least IS NOT NULL)").isEmpty():
            out = materialise(nodes.select("node", F.coalesce("least", "node").alias("component")).coalesce(parts), "components")
            discard(now)
            return out
