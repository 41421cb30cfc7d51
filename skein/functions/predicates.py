"""Filter expressions and their compilation into Columns.

Null is the lowest value and equals itself; there is no third truth value. A
compiled predicate is therefore never null, and NOT is a plain complement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..schema import ColumnHandle, ContainerInfo, RelationHandle, Schema, VariantHandle
from ..types import NUMERIC, Index, Op, ValueType, fits


@dataclass(frozen=True)
class FieldRef:
    kind: str
    handle: object = None

    @classmethod
    def id(cls) -> FieldRef:
        return cls("id")

    @classmethod
    def parent(cls, relation: RelationHandle) -> FieldRef:
        return cls("parent", relation)

    @classmethod
    def variant(cls, handle: VariantHandle) -> FieldRef:
        """The discriminator; of the handle only the container counts."""
        return cls("variant", handle)

    @classmethod
    def column(cls, handle: ColumnHandle) -> FieldRef:
        return cls("column", handle)


@dataclass(frozen=True)
class Expr:
    """A tree: ``all``, ``any``, ``not`` or a comparison; empty matches everything."""

    kind: str = "all"
    children: tuple[Expr, ...] = ()
    field: FieldRef | None = None
    op: Op | None = None
    value: object = None

    def __and__(self, other: Expr) -> Expr:
        return all_of(self, other)

    def __or__(self, other: Expr) -> Expr:
        return any_of(self, other)

    def __invert__(self) -> Expr:
        return negate(self)


def where(field: FieldRef | ColumnHandle, op: Op | str, value) -> Expr:
    if isinstance(field, RelationHandle):
        field = FieldRef.parent(field)
    elif isinstance(field, ColumnHandle):
        field = FieldRef.column(field)
    return Expr("cmp", field=field, op=Op(op), value=value)


def all_of(*children: Expr) -> Expr:
    return Expr("all", children)


def any_of(*children: Expr) -> Expr:
    return Expr("any", children)


def negate(child: Expr) -> Expr:
    return Expr("not", (child,))


EVERYTHING = Expr()


def compare(c: Column, op: Op, value) -> Column:
    """Never null: null sorts below every value and equals null."""
    if value is None:
        return {Op.EQ: c.isNull(), Op.NE: c.isNotNull(), Op.GT: c.isNotNull(), Op.LT: F.lit(False), Op.GE: F.lit(True), Op.LE: c.isNull()}[op]
    v = F.lit(value)
    return {
        Op.EQ: lambda: c.eqNullSafe(v),
        Op.NE: lambda: ~c.eqNullSafe(v),
        # a source can take these, unlike coalesce(c > v, false)
        Op.GT: lambda: c.isNotNull() & (c > v),
        Op.GE: lambda: c.isNotNull() & (c >= v),
        Op.LT: lambda: c.isNull() | (c < v),
        Op.LE: lambda: c.isNull() | (c <= v),
    }[op]()


def resolved(schema: Schema, info: ContainerInfo, field: FieldRef) -> tuple[str, ValueType, str | None, Index]:
    """Column name, type, the variant it is limited to, and its index."""
    if field.kind == "id":
        return "item_id", ValueType.UINT64, None, Index.UNIQUE
    if schema.info(field.handle).id != info.id:
        raise QueryError(f"{field.handle!r} is not of {info.name}")
    if field.kind == "variant":
        return "variant", ValueType.STRING, None, Index.NORMAL
    column = schema.relation_info(field.handle) if field.kind == "parent" else schema.column_info(field.handle)
    return column.name, column.type, None if column.variant is None else info.variants[column.variant], column.index


def field_column(schema: Schema, info: ContainerInfo, field: FieldRef) -> Column:
    """The field's value, null where a variant's column doesn't apply."""
    name, _, variant, _ = resolved(schema, info, field)
    c = F.col(name)
    return c if variant is None else F.when(F.col("variant") == variant, c)


def queryable(schema: Schema, info: ContainerInfo, field: FieldRef, special: bool) -> tuple[str, ValueType, str | None]:
    """Only indexed fields can be queried; ``special`` admits those of ordered and interval indexes."""
    name, kind, variant, index = resolved(schema, info, field)
    if index is Index.NONE:
        at = field.handle.column
        in_special = any(at in o.group_by + o.order_by for o in info.ordered) or any(at in (*i.group_by, i.start, i.end) for i in info.intervals)
        if not (special and in_special):
            raise QueryError(f"{info.name}.{name} is not indexed")
    return name, kind, variant


def compiled(schema: Schema, info: ContainerInfo, e: Expr, strict: bool = True) -> Column:
    """``strict`` refuses orderings of types that only know equality, as queries on a container do; filters on a view don't."""
    if e.kind == "all":
        return reduce(lambda a, b: a & b, [compiled(schema, info, c, strict) for c in e.children], F.lit(True))
    if e.kind == "any":
        return reduce(lambda a, b: a | b, [compiled(schema, info, c, strict) for c in e.children], F.lit(False))
    if e.kind == "not":
        return ~compiled(schema, info, e.children[0], strict)
    name, kind, variant = queryable(schema, info, e.field, special=strict)
    if strict and e.op not in (Op.EQ, Op.NE) and kind not in NUMERIC:
        raise QueryError(f"{info.name}.{name} has no order in a query")
    if e.value is not None and not fits(e.value, kind):
        raise QueryError(f"{e.value!r} is not of the type of {info.name}.{name}")
    found = compare(F.col(name), e.op, e.value)
    return found if variant is None else F.col("variant").eqNullSafe(variant) & found


Predicate = Callable[[Column], Column]
