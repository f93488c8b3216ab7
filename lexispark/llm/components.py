"""Connected components of an edge table, by large-star and small-star steps in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from the larger node a to the smaller node b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components", under: str | None = None) -> DataFrame:
    """(node, root) of every node that has an edge (a, b) and isn't the least of its component; root is the least.

    Self-loops and repeated edges don't matter; without edges the result is empty. Each round is staged.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, under=under)
    stars = now.groupBy("a").count().where("count > 1").isEmpty() and now.select("a").intersect(now.select("b")).isEmpty()
    while not stars:
        now = staged(_small_star(_large_star(now)), name, under=under)
        # done when each node has one edge, to a node that has none to a smaller one
        stars = now.groupBy("a").count().where("count > 1").isEmpty() and now.select("a").intersect(now.select("b")).isEmpty()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
