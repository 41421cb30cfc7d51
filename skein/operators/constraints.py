"""Constraints as queries for what violates them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ContainerInfo
from ..types import Index


def duplicates(df: DataFrame, columns: list[str], scope: str | None = None, nulls_count: bool = False, count: str = "n") -> DataFrame:
    """Values that rows share. With ``scope`` only rows with the same non-null scope are compared; null values count only with ``nulls_count``."""
    rows = df
    if not nulls_count:
        rows = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))
    if scope is not None:
        rows = rows.where(F.col(scope).isNotNull())
    return rows.groupBy(*([scope] if scope else []), *columns).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def failing(df: DataFrame, column: str, check: Column) -> DataFrame:
    """Rows that fail a check; null passes."""
    return df.where(F.col(column).isNotNull() & ~check)


def with_computed(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Computed columns in their order, each over those before it; their expressions stay in one projection chain."""
    for name, e in columns.items():
        df = df.withColumn(name, F.expr(e) if isinstance(e, str) else e)
    return df


def recomputed(df: DataFrame, columns: dict[str, str | Column], id_col: str = "item_id") -> DataFrame:
    """id, column, old, new (as text) of computed cells that are not what their expressions give."""
    fresh = df
    for name, e in columns.items():
        fresh = fresh.withColumn(f"_old_{name}", F.col(name)).withColumn(name, F.expr(e) if isinstance(e, str) else e)
    out = [fresh.where(~F.col(n).eqNullSafe(F.col(f"_old_{n}"))).select(id_col, F.lit(n).alias("column"), F.col(f"_old_{n}").cast("string").alias("old"), F.col(n).cast("string").alias("new")) for n in columns]
    return reduce(DataFrame.union, out)


def violations(df: DataFrame, info: ContainerInfo, targets: dict[str, DataFrame] | None = None, stored: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """rule, column and item_id (null where a group breaks it) of all in ``df`` that breaks a container's schema.

    Rules of single rows (variants, nulls, checks) are one pass; checks without SQL run
    as Pandas UDFs. Unique values are counted within ``df`` and sought in ``stored``,
    which has kept its rules so far and isn't checked again. ``targets`` has, by
    relation, the rows that it may point to. ``edges`` (id, parent) is searched for
    cycles.
    """
    found = [_row_rules(df, info)]

    def add(rows: DataFrame, rule: str, column: str, with_id: bool = True) -> None:
        found.append(rows.select(F.lit(rule).alias("rule"), F.lit(column).alias("column"), (F.col("item_id") if with_id else F.lit(None).cast("bigint")).alias("item_id")))

    for c in info.columns:
        if c.index is Index.UNIQUE:
            scope = info.parent.name if info.parent else None
            null_counts = c.unique_null or (c.variant is not None and c.nullable)
            own = df.where(_applies(info, c))
            add(duplicates(own, [c.name], scope, null_counts), "unique", c.name, with_id=False)
            if stored is not None:
                if not null_counts:
                    own = own.where(F.col(c.name).isNotNull())
                taken = stored.where(_applies(info, c)).select(F.col(c.name).alias("_value"), *([F.col(scope).alias("_scope")] if scope else []))
                same = F.col(c.name).eqNullSafe(F.col("_value"))
                add(own.join(taken, same & (F.col(scope) == F.col("_scope")) if scope else same, "left_semi"), "unique", c.name)
        if c.target is not None and targets and c.name in targets:
            known = targets[c.name].select(F.col("item_id").alias("_key"))
            add(df.where(F.col(c.name).isNotNull()).join(known, F.col(c.name) == F.col("_key"), "left_anti"), "reference", c.name)
    if edges is not None:
        from .relations import cyclic

        add(cyclic(edges).select(F.col("id").alias("item_id")), "cycle", info.parent.name)
    return reduce(DataFrame.union, found)


def _applies(info: ContainerInfo, c) -> Column:
    return F.lit(True) if c.variant is None else F.coalesce(F.col("variant") == info.variants[c.variant], F.lit(False))


def python_check(check) -> Callable[[Column], Column]:
    """A check of single values as a Pandas UDF; null passes."""
    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else bool(check(v.item() if hasattr(v, "item") else v)))

    return lambda c: F.coalesce(run(c), F.lit(True))


def python_column(c) -> Callable[..., Column]:
    """A computed column's function of single values as a Pandas UDF; null stays None for the function."""
    compute = c.compute

    @F.pandas_udf(c.spark_type)
    def run(*columns: pd.Series) -> pd.Series:
        plain = [[None if pd.isna(v) else v for v in x.astype(object)] for x in columns]
        return pd.Series([compute(*row) for row in zip(*plain, strict=True)], dtype=object)

    return run


def _row_rules(df: DataFrame, info: ContainerInfo) -> DataFrame:
    rules = []

    def add(broken: Column, rule: str, column: str) -> None:
        rules.append(F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"))))

    right = F.coalesce(F.col("variant").isin(list(info.variants)), F.lit(False)) if info.variants else F.col("variant").isNull()
    add(~right, "variant", "variant")
    passed: dict[str, Column] = {}  # of checks in Python, evaluated on columns of their own
    for c in info.columns:
        applies = _applies(info, c)
        if c.variant is not None:
            add(~applies & F.col(c.name).isNotNull(), "variant column", c.name)
        if not c.nullable:
            add(applies & F.col(c.name).isNull(), "null", c.name)
        if c.check_sql:
            add(applies & F.col(c.name).isNotNull() & ~F.expr(c.check_sql), "check", c.name)
        elif c.check:
            passed[f"_passed_{c.name}"] = python_check(c.check)(F.col(c.name))
            add(applies & F.col(c.name).isNotNull() & ~F.col(f"_passed_{c.name}"), "check", c.name)
    rows = df.withColumns(passed) if passed else df
    return rows.select(F.explode(F.array_compact(F.array(*rules))).alias("_broken"), "item_id").select("_broken.rule", "_broken.column", "item_id")
