"""Connected components by alternating star contraction, on executors only.

Each round is one groupBy with map-side combine and one join; its result is written to the shared folder, so the lineage stays
one round deep. A hub with very many links is only ever a join key that AQE can split, never a gathered list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidy


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is hung under the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is hung under the smallest of them. Needs a > b in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    # the link to the smallest stands for u itself
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. ``edges`` has long columns a and b.

    Self-links and repeated links are ignored; an empty table of links gives an empty result.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(now):
        large = materialise(_large_star(now), "large-star")
        after = materialise(_small_star(large), "small-star")
        discard(large)
        discard(now)
        now = after
    tidy(now.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links: ``found`` is what ``components`` gave for the earlier ones. Only classes that a further link touches are linked anew."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = materialise(components(between), "moved-classes")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return found.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")).union(moved).distinct()


def _stars(edges: DataFrame) -> bool:
    """Each larger node has one link and is nobody's smaller one: a further round would change nothing. One grouping instead of that round."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("b"), F.lit(0)))
    more = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR up = 1 AND least = 0")
    return more.agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0
