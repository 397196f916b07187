"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grootboek.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (u, v); the label is the smallest node that can be reached.

    Large-star and small-star steps by turns until all edges are stars: every node points its larger neighbours, then its
    smaller ones, at the smallest node it knows. Steps are aggregations and joins on nodes, so a node with very many
    neighbours is combined before the shuffle and split in the join. Loops and repeated edges do no harm; null ends are
    dropped; without edges there are no rows.
    """
    current = stored(_tidy(edges.select("u", "v")), "edges")
    while not _are_stars(current):
        current = stored(_small_star(_large_star(current)), "edges")
    pointed = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return pointed.unionByName(pointed.select(F.col("label").alias("node"), "label").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end ``u`` to its smaller end ``v``."""
    return (
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger ones, or larger ones only; no step changes that."""
    ends = edges.select("u", F.lit(1).alias("low")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("low")))
    counts = ends.groupBy("u").agg(F.sum("low").alias("low"), F.count("*").alias("n"))
    return counts.filter("low > 1 or low = 1 and n > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("least"))
    larger = edges.select(F.col("v").alias("centre"), F.col("u").alias("far"))
    of_centre = smallest.withColumnRenamed("u", "centre")
    # A centre without smaller neighbours is the smallest itself.
    return _tidy(
        larger.join(of_centre, "centre", "left").select(
            F.col("far").alias("u"), F.coalesce("least", "centre").alias("v")
        )
        .unionByName(smallest.select("u", F.col("least").alias("v")))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("least"))
    return _tidy(
        edges.join(smallest, "u")
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
        .unionByName(smallest.select("u", F.col("least").alias("v")))
    )
