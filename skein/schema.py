"""Schemas: built once, then frozen.

A container is a table, or a list whose items are in groups by one association,
each group a sequence with positions from 0. The schema fixes columns (stored,
computed, of a variant), associations and hints; hints may change a physical
layout, never a result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import HandleError, SchemaError
from .types import COMPARABLE, NUMERIC, SPARK_TYPES, Index, Kind, Stage, ValueType

_schemas = itertools.count(1)


@dataclass(frozen=True)
class Handle:
    schema: int
    container: int
    name: str = field(compare=False, default="")


@dataclass(frozen=True)
class TableHandle(Handle):
    pass


@dataclass(frozen=True)
class ListHandle(Handle):
    pass


@dataclass(frozen=True)
class ColumnHandle(Handle):
    column: int = 0


@dataclass(frozen=True)
class RelationHandle(ColumnHandle):
    """An association; its column holds the target's item id."""


@dataclass(frozen=True)
class VariantHandle(Handle):
    variant: int = 0


@dataclass(frozen=True)
class IndexHandle(Handle):
    index: int = 0


@dataclass(frozen=True)
class AggregateHint:
    sum: bool = True
    min_max: bool = True
    by_parent: bool = True


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: ValueType
    index: Index = Index.NONE
    default: object = None
    nullable: bool = True
    unique_null: bool = False
    hint: AggregateHint | None = None
    check: Callable[[object], bool] | None = None
    check_sql: str | None = None  # the same for sets of rows, over the column's name
    variant: int | None = None
    depends: tuple[int, ...] = ()
    compute: Callable | None = None
    compute_sql: str | None = None
    target: int | None = None  # of an association

    @property
    def computed(self) -> bool:
        return self.compute is not None or self.compute_sql is not None

    @property
    def spark_type(self) -> T.DataType:
        return T.LongType() if self.target is not None else SPARK_TYPES[self.type]


@dataclass(frozen=True)
class OrderedIndex:
    group_by: tuple[int, ...]
    order_by: tuple[int, ...]
    tie_break_by_id: bool = True  # ids always break ties


@dataclass(frozen=True)
class IntervalIndex:
    group_by: tuple[int, ...]
    start: int
    end: int


@dataclass(frozen=True)
class Hook:
    stage: Stage
    run: Callable


@dataclass(frozen=True)
class ContainerInfo:
    id: int
    name: str
    kind: Kind
    columns: tuple[ColumnInfo, ...] = ()
    variants: tuple[str, ...] = ()
    association: int | None = None  # a list's column
    range_indexes: tuple[tuple[int, ...], ...] = ()
    ordered: tuple[OrderedIndex, ...] = ()
    intervals: tuple[IntervalIndex, ...] = ()
    hooks: tuple[Hook, ...] = ()

    @property
    def relations(self) -> list[int]:
        return [i for i, c in enumerate(self.columns) if c.target is not None]

    @property
    def parent(self) -> ColumnInfo | None:
        """The relation that cascades, cycles and unique scopes follow: the last."""
        return self.columns[self.relations[-1]] if self.relations else None

    def column(self, name: str) -> ColumnInfo:
        for c in self.columns:
            if c.name == name:
                return c
        raise HandleError(f"{self.name} has no column {name}")

    @property
    def struct(self) -> T.StructType:
        """Of the container's rows."""
        fields = [T.StructField("item_id", T.LongType(), False), T.StructField("variant", T.StringType()), T.StructField("list_index", T.LongType())]
        return T.StructType(fields + [T.StructField(c.name, c.spark_type) for c in self.columns])


@dataclass(frozen=True)
class Schema:
    id: int
    containers: tuple[ContainerInfo, ...]

    def info(self, handle: Handle) -> ContainerInfo:
        if not isinstance(handle, Handle) or handle.schema != self.id or not 0 <= handle.container < len(self.containers):
            raise HandleError(f"{handle!r} is not of this schema")
        return self.containers[handle.container]

    def table_info(self, handle: TableHandle) -> ContainerInfo:
        info = self.info(handle)
        if not isinstance(handle, TableHandle) or info.kind is not Kind.TABLE:
            raise HandleError(f"{info.name} is not a table")
        return info

    def list_info(self, handle: ListHandle) -> ContainerInfo:
        info = self.info(handle)
        if not isinstance(handle, ListHandle) or info.kind is not Kind.LIST:
            raise HandleError(f"{info.name} is not a list")
        return info

    def column_info(self, handle: ColumnHandle) -> ColumnInfo:
        info = self.info(handle)
        if not isinstance(handle, ColumnHandle) or not 0 <= handle.column < len(info.columns):
            raise HandleError(f"{handle!r} is not a column of {info.name}")
        return info.columns[handle.column]

    def relation_info(self, handle: RelationHandle) -> ColumnInfo:
        column = self.column_info(handle)
        if column.target is None:
            raise HandleError(f"{column.name} is not an association")
        return column

    def structure(self) -> str:
        """Canonical JSON of what stored data depends on: no nullability, defaults, checks, hooks or functions."""
        out = []
        for c in self.containers:
            columns = [[x.name, x.type.value, x.index.value, x.variant, list(x.depends), x.target, x.computed] for x in c.columns]
            out.append({"name": c.name, "kind": c.kind.value, "columns": columns, "variants": c.variants, "association": c.association, "ranges": c.range_indexes, "ordered": [[o.group_by, o.order_by] for o in c.ordered], "intervals": [[i.group_by, i.start, i.end] for i in c.intervals]})
        return json.dumps(out, sort_keys=True, separators=(",", ":"))

    def matches(self, structure: str) -> bool:
        return structure == self.structure()

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.structure().encode()).hexdigest()


class SchemaBuilder:
    """Collects containers; ``freeze`` checks them and gives the schema."""

    def __init__(self):
        self.id = next(_schemas)
        self._builders: list[ContainerBuilder] = []
        self._frozen = False

    def _open(self) -> None:
        if self._frozen:
            raise SchemaError("the schema is frozen")

    def create_table(self, name: str) -> TableBuilder:
        return self._create(TableBuilder, name, Kind.TABLE)

    def create_list(self, name: str) -> ListBuilder:
        return self._create(ListBuilder, name, Kind.LIST)

    def _create(self, kind: type, name: str, what: Kind):
        self._open()
        if not name:
            raise SchemaError("a container needs a name")
        self._builders.append(b := kind(self, len(self._builders), name, what))
        return b

    def freeze(self) -> Schema:
        self._open()
        if not self._builders:
            raise SchemaError("a schema needs a container")
        names = [b.name for b in self._builders]
        if len(set(names)) != len(names):
            raise SchemaError("two containers have the same name")
        schema = Schema(self.id, tuple(b.checked() for b in self._builders))
        self._frozen = True
        return schema


class ContainerBuilder:
    def __init__(self, owner: SchemaBuilder, at: int, name: str, kind: Kind):
        self.owner, self.at, self.name = owner, at, name
        self.made = ContainerInfo(at, name, kind)

    @property
    def handle(self) -> TableHandle | ListHandle:
        return (TableHandle if self.made.kind is Kind.TABLE else ListHandle)(self.owner.id, self.at, self.name)

    def _put(self, **changes) -> None:
        self.owner._open()
        self.made = replace(self.made, **changes)

    def _column(self, info: ColumnInfo, kind: type = ColumnHandle):
        if info.type is ValueType.NULL:
            raise SchemaError("null is not a column type")
        if not info.name or info.name in {"item_id", "variant", "list_index"} or info.name in {c.name for c in self.made.columns}:
            raise SchemaError(f"{self.name} can't have a column {info.name!r}")
        self._put(columns=(*self.made.columns, info))
        return kind(self.owner.id, self.at, info.name, len(self.made.columns) - 1)

    def add_column(self, name: str, type: ValueType, **options) -> ColumnHandle:
        return self._column(ColumnInfo(name, type, **options))

    def add_computed_column(self, name: str, type: ValueType, depends: list[ColumnHandle], compute: Callable | None = None, compute_sql: str | None = None, **options) -> ColumnHandle:
        """``compute`` gets the values of ``depends``, which were declared before; ``compute_sql`` is the same over their names."""
        if compute is None and compute_sql is None:
            raise SchemaError("a computed column needs a function")
        at = self._own(depends)
        return self._column(ColumnInfo(name, type, depends=at, compute=compute, compute_sql=compute_sql, **options))

    def _association(self, name: str, target: Handle, nullable: bool) -> RelationHandle:
        if not isinstance(target, Handle) or target.schema != self.owner.id:
            raise SchemaError("the target is not of this schema")
        return self._column(ColumnInfo(name, ValueType.UINT64, Index.NORMAL, nullable=nullable, target=target.container), RelationHandle)

    def add_variant(self, name: str) -> VariantHandle:
        if name in self.made.variants:
            raise SchemaError(f"{self.name} has the variant {name} already")
        self._put(variants=(*self.made.variants, name))
        return VariantHandle(self.owner.id, self.at, name, len(self.made.variants) - 1)

    def add_variant_column(self, variant: VariantHandle, name: str, type: ValueType, **options) -> ColumnHandle:
        if variant.schema != self.owner.id or variant.container != self.at or not 0 <= variant.variant < len(self.made.variants):
            raise SchemaError(f"{self.name} has no such variant")
        return self._column(ColumnInfo(name, type, variant=variant.variant, **options))

    def _own(self, columns: list[ColumnHandle]) -> tuple[int, ...]:
        for c in columns:
            if not isinstance(c, ColumnHandle) or c.schema != self.owner.id or c.container != self.at or not 0 <= c.column < len(self.made.columns):
                raise SchemaError(f"{c!r} is not an earlier column of {self.name}")
        return tuple(c.column for c in columns)

    def add_range_index(self, columns: list[ColumnHandle]) -> IndexHandle:
        at = self._own(columns)
        info = [self.made.columns[i] for i in at]
        if len(set(at)) < 2 or any(c.type not in NUMERIC or c.index is Index.NONE for c in info):
            raise SchemaError("a range index needs two indexed numeric columns at least")
        self._put(range_indexes=(*self.made.range_indexes, at))
        return IndexHandle(self.owner.id, self.at, "range", len(self.made.range_indexes) - 1)

    def add_ordered_index(self, order_by: list[ColumnHandle], group_by: list[ColumnHandle] = (), tie_break_by_id: bool = True) -> IndexHandle:
        order, group = self._own(list(order_by)), self._own(list(group_by))
        if not order or any(self.made.columns[i].type not in COMPARABLE for i in order):
            raise SchemaError("an ordered index needs comparable columns")
        self._put(ordered=(*self.made.ordered, OrderedIndex(group, order, tie_break_by_id)))
        return IndexHandle(self.owner.id, self.at, "ordered", len(self.made.ordered) - 1)

    def add_interval_index(self, start: ColumnHandle, end: ColumnHandle, group_by: list[ColumnHandle] = ()) -> IndexHandle:
        (a, z), group = self._own([start, end]), self._own(list(group_by))
        if a == z or self.made.columns[a].type is not self.made.columns[z].type or self.made.columns[a].type not in NUMERIC:
            raise SchemaError("an interval index needs two numeric columns of a type")
        self._put(intervals=(*self.made.intervals, IntervalIndex(group, a, z)))
        return IndexHandle(self.owner.id, self.at, "interval", len(self.made.intervals) - 1)

    def add_hook(self, stage: Stage, run: Callable) -> None:
        if not callable(run) or stage is Stage.ROLLBACK:
            raise SchemaError("a hook needs a function and one of the four stages")
        self._put(hooks=(*self.made.hooks, Hook(stage, run)))

    def checked(self) -> ContainerInfo:
        if self.made.kind is Kind.LIST and self.made.association is None:
            raise SchemaError(f"the list {self.name} needs an association")
        for c in self.made.columns:
            if c.hint and c.type not in NUMERIC:
                raise SchemaError(f"{c.name} is not numeric and can't have an aggregate hint")
        return self.made


class TableBuilder(ContainerBuilder):
    def add_association(self, name: str, target: Handle, nullable: bool = True) -> RelationHandle:
        return self._association(name, target, nullable)


class ListBuilder(ContainerBuilder):
    def set_association(self, name: str, target: Handle, nullable: bool = True) -> RelationHandle:
        if self.made.association is not None:
            raise SchemaError(f"{self.name} has its association already")
        h = self._association(name, target, nullable)
        self._put(association=h.column)
        return h
