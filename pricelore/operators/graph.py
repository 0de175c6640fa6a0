"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), with the lineage cut in each round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelore.shared import reliable


def _sum(links: DataFrame) -> tuple:
    """The count of links and a sum over two hashes of them: equal for equal sets, and for different ones by a chance of about 2 ** -120 only."""
    hashes = [F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(links.agg(F.count("*"), *hashes).first())


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = reliable, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the least node of its component. Self loops and repeats are allowed; null ends are dropped.

    Every round moves each node's links to the least neighbour it knows; the result is a star for each component. Raises if ``max_rounds`` don't suffice.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    known = _sum(links)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the node's least neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # repeats go with those of the round
        # small star: a node's smaller neighbours, and the node, link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        before, known = known, _sum(links)
        if known == before:
            break
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
