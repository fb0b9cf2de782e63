"""Connected components of a large link table: alternating large-star and small-star rounds.

Each round is a grouped minimum and a join, both of which Spark combines early or splits when one vertex has very many
links; no adjacency list is gathered.  Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b.  One star operation; returns links (a, b) with a > b, without repeats."""
    around = links
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    moved = around.join(least, "a")
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of links (a, b) of longs; root is the smallest node of the component.

    Stops when a round leaves the links as they are; then each node is linked to its root alone.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct()
    now = scratch.keep(now)
    mark = None
    while True:
        new = scratch.keep(_stars(_stars(now, True), False))
        scratch.drop(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
