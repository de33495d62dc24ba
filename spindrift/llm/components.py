"""Connected components of an edge table, by large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node next to it. Edges lead from larger to smaller."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    return edges.join(least, "b").select("a", F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node itself, move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node leads to one other at most, and none to a node that leads on."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return n == nodes and edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi").isEmpty()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round joins every node's neighbours to the smallest of them; about log(diameter) rounds, none where
    all edges lead to the smallest node already.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    while not _stars(now):
        now = staged(_small(_large(now)), tag)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
