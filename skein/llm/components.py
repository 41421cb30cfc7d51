"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, persisted


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of ``edges`` (a, b; no nulls, self-loops allowed).

    Each round joins edges with a minimum that is summed map-side, so that a hub is
    split like any skewed join key; lineage is cut by a written table each round, and
    the table before it goes.
    The number of rounds grows with the logarithm of the largest component.
    """
    e, now = _counted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        last, before = e, now
        e, now = _counted(small.union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        discard(last)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and a sum of their hashes, which are taken as they are written."""
    seen = Observation()
    h = F.xxhash64("a", "b")
    out = persisted(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("x"), F.sum(F.pmod(F.shiftright(h, 31), F.lit(1 << 31))).alias("y")))
    got = seen.get
    return out, (got["n"], got["x"], got["y"])
