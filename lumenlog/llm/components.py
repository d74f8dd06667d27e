"""Connected components of links that stay in Spark: alternating large and small stars.

Every round relinks each vertex's larger neighbours to its least neighbour, then its smaller ones, until every
vertex but the least of its component has one link, to that one; rounds grow with the logarithm of a component's
size, and links that are such stars already take none.  Least neighbours are a map-side combined minimum, written
out before they are joined back, so a hub of any degree is a skewed join side that Spark can split, never a
group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(both: DataFrame, name: str) -> DataFrame:
    least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-least")
    return both.join(least, "u")


def settled(edges: DataFrame) -> bool:
    """Whether every vertex is either the upper end of one edge or a lower end, that is, whether all parts are stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return not odd.head(1)


def connected_components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex that is not the least of its component; ``links`` has longs a and b.

    It fails if the components have not settled after ``rounds``, which are enough for 2 ** rounds vertices in a row.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    for _ in range(rounds):
        if settled(edges):
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        low = _star(large, "small")
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "small")
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
