"""Lazy views: a specification that builds its DataFrame anew for each action."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.predicates import EVERYTHING, Expr, FieldRef, compiled, field_column, queryable
from ..schema import ColumnHandle, ContainerInfo, RelationHandle, Schema
from ..types import COMPARABLE, NUMERIC, Aggregate, Kind


@dataclass(frozen=True)
class SortKey:
    field: FieldRef
    descending: bool = False


@dataclass(frozen=True)
class QuerySpec:
    filter: Expr = EVERYTHING
    sort: tuple[SortKey, ...] = ()


def ascending(field) -> SortKey:
    return SortKey(_field(field))


def descending(field) -> SortKey:
    return SortKey(_field(field), True)


def _field(field) -> FieldRef:
    if isinstance(field, RelationHandle):
        return FieldRef.parent(field)
    return FieldRef.column(field) if isinstance(field, ColumnHandle) else field


class View:
    """A query's result, live: every action sees the state of that moment.

    Offset comes before limit whatever the order of the calls; offsets add up and
    the least limit counts. Filtering or sorting a view that has either works on
    its limited rows.
    """

    def __init__(self, source: Callable[[], DataFrame], schema: Schema, info: ContainerInfo, steps: tuple = (), order: tuple[Column, ...] | None = None, skip: int = 0, most: int | None = None):
        self._source, self.schema, self.info, self._steps = source, schema, info, steps
        self._order, self._skip, self._most = order, skip, most

    @classmethod
    def query(cls, source: Callable[[], DataFrame], schema: Schema, info: ContainerInfo, spec: QuerySpec = QuerySpec()) -> View:
        where = compiled(schema, info, spec.filter, strict=True)
        order = tuple(_sort_columns(schema, info, spec.sort, special=True))
        return cls(source, schema, info, (lambda df: df.where(where),) if spec.filter != EVERYTHING else (), order)

    def _with(self, **changes) -> View:
        now = {"source": self._source, "schema": self.schema, "info": self.info, "steps": self._steps, "order": self._order, "skip": self._skip, "most": self._most} | changes
        return View(**now)

    def _default_order(self) -> tuple[Column, ...]:
        return (F.coalesce(F.col("list_index"), F.lit(0)).asc(), F.col("item_id").asc()) if self.info.kind is Kind.LIST else (F.col("item_id").asc(),)

    def _ordering(self) -> tuple[Column, ...]:
        own = self._order or ()
        return (*own, *self._default_order())

    def _limited(self) -> bool:
        return bool(self._skip) or self._most is not None

    def _frozen_rows(self) -> View:
        """A view of this one's limited rows."""
        if not self._limited():
            return self
        return View(self.dataframe, self.schema, self.info, (), self._order)

    def filter(self, expr: Expr) -> View:
        where = compiled(self.schema, self.info, expr, strict=False)
        base = self._frozen_rows()
        return base._with(steps=(*base._steps, lambda df: df.where(where)))

    def sort(self, *keys: SortKey) -> View:
        base = self._frozen_rows()
        return base._with(order=(*_sort_columns(self.schema, self.info, keys, special=False), *(base._order or ())))

    def limit(self, n: int) -> View:
        return self._with(most=n if self._most is None else min(n, self._most))

    def offset(self, n: int) -> View:
        return self._with(skip=self._skip + n)

    def _unordered(self) -> DataFrame:
        df = self._source()
        for step in self._steps:
            df = step(df)
        return df

    def dataframe(self, ordered: bool = True) -> DataFrame:
        """The rows; ``ordered`` sorts them where only their order would need it. Limits always do.

        An offset without a limit leaves most rows, so that places are numbered by
        range partitions instead of passing all rows through one task.
        """
        if self._skip and self._most is None:
            left = self._numbered("_place").where(F.col("_place") >= self._skip)
            return (left.orderBy("_place") if ordered else left).drop("_place")
        df = self._unordered()
        if ordered or self._limited():
            df = df.orderBy(*self._ordering())
        if self._skip:
            df = df.offset(self._skip)
        return df if self._most is None else df.limit(self._most)

    def positioned(self, name: str = "pos") -> DataFrame:
        """All rows with their place in the view's order, from 0, numbered by range partitions."""
        base = self._frozen_rows()
        return base._numbered(name)

    def _numbered(self, name: str) -> DataFrame:
        from ..operators.numbering import numbered

        return numbered(self._unordered(), *self._ordering(), name=name)

    def select(self, *columns) -> DataFrame:
        return self.dataframe(ordered=False).select(*columns)

    def to_rows(self) -> list[Row]:
        return self.dataframe().collect()

    def for_each(self, visit: Callable[[Row], bool | None]) -> None:
        """Stops when the visitor returns False."""
        for row in self.dataframe().toLocalIterator():
            if visit(row) is False:
                break

    def __iter__(self) -> Iterator[Row]:
        return self.dataframe().toLocalIterator()

    def count(self) -> int:
        """Needs no order: which rows a limit leaves doesn't change their number."""
        n = max(0, self._unordered().count() - self._skip)
        return n if self._most is None else min(n, self._most)

    def empty(self) -> bool:
        if self._most == 0:
            return True
        df = self._unordered()
        return (df.offset(self._skip) if self._skip else df).isEmpty()

    def aggregate(self, kind: Aggregate | str, value=None, group_by=None) -> AggregationView:
        return AggregationView(self, (self._wanted(kind, value),), self._grouping(group_by))

    def aggregates(self, *wanted: tuple, group_by=None) -> AggregationView:
        """Several aggregates, each (kind, value) or (kind,), of one pass over the rows."""
        return AggregationView(self, tuple(self._wanted(*w) for w in wanted), self._grouping(group_by))

    def _wanted(self, kind: Aggregate | str, value=None) -> tuple[Aggregate, FieldRef | None]:
        kind, value = Aggregate(kind), _field(value)
        if value is not None:
            _, kind_of, _ = queryable(self.schema, self.info, value, special=False)
            if kind is Aggregate.SUM and kind_of not in NUMERIC:
                raise QueryError("only numbers have a sum")
        elif kind in (Aggregate.MIN, Aggregate.MAX):
            raise QueryError("a minimum or maximum needs a field")
        return kind, value

    def _grouping(self, group_by) -> FieldRef | None:
        group_by = _field(group_by)
        if group_by is not None:
            queryable(self.schema, self.info, group_by, special=False)
        return group_by


class AggregationView:
    """group_key (only if grouped) and value of each group; without groups always one row. Of several aggregates, value_1, value_2, …

    Counts are 0 without rows; sums ignore nulls and keep the type (integers become
    longs; unsigned wider decimals); a minimum is null if any value is, since null is
    the lowest; a maximum ignores nulls. A variant's field counts only where it applies.
    """

    def __init__(self, view: View, wanted: tuple[tuple[Aggregate, FieldRef | None], ...], group: FieldRef | None):
        self._view, self._wanted, self._group = view, wanted, group

    def _made(self, kind: Aggregate, value: FieldRef | None) -> Column:
        v = self._view
        applies = F.lit(True)
        c = F.lit(1)
        if value is not None:
            c = field_column(v.schema, v.info, value)
            *_, variant = queryable(v.schema, v.info, value, special=False)
            if variant is not None:
                applies = F.col("variant") == variant
        if kind is Aggregate.COUNT:
            return F.count(F.lit(1))
        if kind is Aggregate.SUM:
            return F.sum(c)
        if kind is Aggregate.MIN:
            return F.when(F.max(applies & c.isNull()), None).otherwise(F.min(c))
        return F.max(c)

    def dataframe(self, *names: str, value: str = "value", group: str = "group_key") -> DataFrame:
        """``names`` are those of the aggregates in their order, and then that of the group."""
        given = [*names, *([] if len(names) >= len(self._wanted) else [value] if len(self._wanted) == 1 else [f"{value}_{i}" for i in range(1, len(self._wanted) + 1)])]
        group = names[len(self._wanted)] if len(names) > len(self._wanted) else group
        made = [self._made(kind, field).alias(name) for (kind, field), name in zip(self._wanted, given, strict=False)]
        v = self._view
        df = v.dataframe(ordered=False)
        if self._group is None:
            return df.agg(*made)
        return df.groupBy(field_column(v.schema, v.info, self._group).alias(group)).agg(*made)

    def to_rows(self) -> list[Row]:
        return self.dataframe().collect()

    def for_each(self, visit: Callable[[Row], bool | None]) -> None:
        for row in self.dataframe().toLocalIterator():
            if visit(row) is False:
                break


def _sort_columns(schema: Schema, info: ContainerInfo, keys, special: bool) -> list[Column]:
    out = []
    for k in keys:
        _, kind, _ = queryable(schema, info, k.field, special)
        if kind not in COMPARABLE:
            raise QueryError("the field has no order")
        c = field_column(schema, info, k.field)
        out.append(c.desc_nulls_last() if k.descending else c.asc_nulls_first())
    return out
