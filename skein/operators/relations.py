"""Parents and children: joins, referential checks, descendants and ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError
from ..sources.tables import persisted


def children_of(df: DataFrame, fk: str, parents: list) -> DataFrame:
    """Rows whose relation is one of some constants; duplicates don't count twice, and None selects the unattached."""
    keys = list(dict.fromkeys(p for p in parents if p is not None))
    where = F.coalesce(F.col(fk).isin(keys), F.lit(False)) if keys else F.lit(False)
    return df.where(where | F.col(fk).isNull()) if None in parents else df.where(where)


def with_parent(child: DataFrame, parent: DataFrame, fk: str, key: str, how: str = "inner") -> DataFrame:
    """An equi join; the planner broadcasts a side by its measured size."""
    return child.join(parent, child[fk] == parent[key], how)


def having_children(parent: DataFrame, child: DataFrame, key: str, fk: str) -> DataFrame:
    return parent.join(child.select(F.col(fk).alias("_fk")), F.col(key) == F.col("_fk"), "left_semi")


def dangling(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Rows whose non-null relation has no target."""
    targets = parent.select(F.col(key).alias("_key"))
    return child.where(F.col(fk).isNotNull()).join(targets, F.col(fk) == F.col("_key"), "left_anti")


def descendants(edges: DataFrame, roots: list[int], max_depth: int = 1000) -> DataFrame:
    """id and depth of the roots and all below them; edges has id and parent.

    A join for each level, whose rows are written before the next, so that lineage
    stays short and a lost executor costs one level. A row met twice is kept once.
    """
    frontier = edges.where(F.col("id").isin(list(roots))).select("id").withColumn("depth", F.lit(0))
    found = frontier = persisted(frontier.distinct())
    for depth in range(1, max_depth + 1):
        below = edges.join(frontier.select(F.col("id").alias("_p")), F.col("parent") == F.col("_p")).select("id")
        below = below.distinct().join(found.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = persisted(below)
        if frontier.isEmpty():
            return found
        found = found.union(frontier)
    raise ConstraintError(f"the hierarchy is deeper than {max_depth}")


def ancestors(edges: DataFrame, start: int, max_depth: int = 1000) -> DataFrame:
    """id and depth of an item and its chain of parents; a cycle or a missing parent is an error."""
    spark = edges.sparkSession
    chain, at = [], start
    while at is not None:
        if at in chain or len(chain) > max_depth:
            raise ConstraintError("parents form a cycle")
        row = edges.where(F.col("id") == at).select("parent").first()
        if row is None:
            raise ConstraintError(f"parent {at} doesn't exist")
        chain.append(at)
        at = row.parent
    return spark.createDataFrame([(x, i) for i, x in enumerate(chain)], "id bigint, depth int")


def cyclic(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Ids whose chain of parents never ends, by pointer doubling: rounds grow with the logarithm of the depth."""
    at = persisted(edges.select("id", F.col("parent").alias("up")))
    for _ in range(max_rounds):
        step = at.select(F.col("id").alias("_i"), F.col("up").alias("_u"))
        after = persisted(at.where("up is not null").join(step, F.col("up") == F.col("_i"), "left").select("id", F.col("_u").alias("up")).where("up is not null"))
        if after.isEmpty():
            return after.select("id")
        if after.count() == at.count():
            return after.select("id")
        at = after
    return at.select("id")
