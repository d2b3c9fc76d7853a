"""Connected components by alternating large-star and small-star rounds.

Every step is a map-side combined minimum and an equi-join, so a hub with a third of all
edges is combined before it is shuffled and its join partition can be split.  Each round is
written to the shared scratch folder; nothing but two checksums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(_least(both), "a").where("b > a")
    return near.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = _least(edges)
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node ``a`` that is not the least of its component.

    ``edges``: columns a and b, orderable ids of one type; direction, repeats and loops
    don't matter, rows with a null are left out.
    """
    stars = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _checksum(stars)
    while before[0]:
        stars = materialize(_small_star(_large_star(stars)), "stars")
        if (now := _checksum(stars)) == before:
            break
        before = now
    return stars.select("a", F.col("b").alias("root"))
