"""Connected components of a graph given by its links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, written


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b). (node, component) for each node that has a link; component is the smallest node reachable.

    Alternates large stars (each node links its larger neighbours to its smallest one) and small stars (it links itself
    and its smaller neighbours to the smallest), which keep what is connected and shorten chains whatever the order of
    their ids, until only stars around the smallest nodes are left. Every round is two written tables; aggregation is
    partial before each shuffle.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), "links")
    while not _stars(edges):
        large = written(_large_star(edges), "large")
        small = written(_small_star(large), "small")
        deleted(edges, large)
        edges = small
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "at")
    return both.where("b > a").join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: (a, b), a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least.withColumnRenamed("a", "at"), F.col("a") == F.col("at")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each larger node has one link, to a node that has none to a smaller one."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("a").alias("larger")), F.col("b") == F.col("larger"), "left_semi").isEmpty()
