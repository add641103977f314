"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtable.plans.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``links``
    (columns ``a``, ``b``).

    Large-star and small-star steps in turn: every node hands its larger neighbours, then
    its smaller ones, to the smallest node it knows. Links only get fewer or shorter, and
    after a number of rounds that grows as the logarithm squared at most, each component is
    a star around its smallest node. Neighbours are never gathered: each step is an
    aggregation to one row per node and a join back.
    """
    edges = stage(_tidy(links.select("a", "b")))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node go to the smallest of it and its neighbours.
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        known = both.filter("b > a").join(least, F.col("a") == F.col("n"))
        large = stage(_tidy(known.select(F.col("b").alias("a"), F.least("m", "n").alias("b"))))
        # Small star: a node and its neighbours below it go to the smallest of these.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        known = down.join(least, F.col("a") == F.col("n"))
        ends = F.explode(F.array("a", "b")).alias("a")
        small = stage(_tidy(known.select(ends, F.col("m").alias("b"))))
        same = small.count() == edges.count() and small.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stage(stars.unionByName(centres))


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller, no node to itself."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
