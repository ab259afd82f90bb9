"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the
    smallest node reachable.

    Each round lowers a node's root to the smallest root among its neighbours
    and then follows the root's own root, so long paths shrink geometrically.
    Rounds are written to the shared folder; only a count reaches the driver.
    """
    there = edges.select(F.col("a").alias("node"), F.col("b").alias("peer"))
    both = there.union(there.select(F.col("peer"), F.col("node")))
    both = cut(both.where(F.col("node") != F.col("peer")), "edges")
    n = both.count()
    roots = cut(both.groupBy("node").agg(F.least("node", F.min("peer")).alias("root")), "roots", n)
    while True:
        heard = both.join(roots.withColumnRenamed("node", "peer"), "peer").groupBy("node").agg(F.min("root").alias("heard"))
        lower = roots.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        lower = cut(lower, "roots", 2 * n)
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        lower = cut(lower.join(up, "root").select("node", "was", F.least("root", "top").alias("root")), "roots", 2 * n)
        changed = lower.where(F.col("was") != F.col("root")).limit(1).count()
        roots = lower.select("node", "root")
        if not changed:
            return roots
