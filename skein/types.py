"""Value types and enumerations."""

from __future__ import annotations

import enum
import math

from pyspark.sql import types as T

from .errors import ConstraintError


class ValueType(enum.Enum):
    NULL = 0
    BOOL = 1
    INT64 = 2
    UINT64 = 3
    DOUBLE = 4
    STRING = 5
    BINARY = 6


NUMERIC = {ValueType.INT64, ValueType.UINT64, ValueType.DOUBLE}
COMPARABLE = NUMERIC | {ValueType.BOOL, ValueType.STRING}

#: Item ids and relations fit a signed long; other unsigned values need a decimal.
SPARK_TYPES = {
    ValueType.BOOL: T.BooleanType(),
    ValueType.INT64: T.LongType(),
    ValueType.UINT64: T.DecimalType(20, 0),
    ValueType.DOUBLE: T.DoubleType(),
    ValueType.STRING: T.StringType(),
    ValueType.BINARY: T.BinaryType(),
}


class Index(enum.Enum):
    NONE = 0
    NORMAL = 1
    UNIQUE = 2


class Kind(enum.Enum):
    TABLE = "table"
    LIST = "list"


class Op(enum.Enum):
    EQ = "="
    NE = "!="
    GT = ">"
    LT = "<"
    GE = ">="
    LE = "<="


class Aggregate(enum.Enum):
    COUNT = "count"
    SUM = "sum"
    MIN = "min"
    MAX = "max"


class Origin(enum.Enum):
    NORMAL = "normal"
    UNDO = "undo"
    REDO = "redo"


class Stage(enum.Enum):
    BEFORE_APPLY = "before_apply"
    AFTER_APPLY = "after_apply"
    BEFORE_COMMIT = "before_commit"
    AFTER_COMMIT = "after_commit"
    ROLLBACK = "rollback"  # of events only


class TransactionState(enum.Enum):
    ACTIVE = "active"
    COMMITTED = "committed"
    ROLLED_BACK = "rolled_back"
    FAILED = "failed"


class Change(enum.Enum):
    ITEM_INSERTED = "item_inserted"
    ITEM_REMOVED = "item_removed"
    CASCADE_REMOVED = "cascade_removed"
    LIST_INSERTED = "list_inserted"
    LIST_REMOVED = "list_removed"
    COLUMN_UPDATED = "column_updated"
    COMPUTED_UPDATED = "computed_updated"
    LIST_ROTATED = "list_rotated"


def value_type(value) -> ValueType:
    """The type of a Python value; ints are INT64."""
    if value is None:
        return ValueType.NULL
    for kind, t in ((bool, ValueType.BOOL), (int, ValueType.INT64), (float, ValueType.DOUBLE), (str, ValueType.STRING), ((bytes, bytearray), ValueType.BINARY)):
        if isinstance(value, kind):
            return t
    raise ConstraintError(f"no value type for {type(value).__name__}")


def fits(value, kind: ValueType) -> bool:
    """Whether a non-null value is of the type: there is no coercion, and no NaN."""
    got = value_type(value)
    if kind is ValueType.UINT64:
        return got is ValueType.INT64 and 0 <= value < 1 << 64
    if kind is ValueType.INT64:
        return got is ValueType.INT64 and -(1 << 63) <= value < 1 << 63
    if kind is ValueType.DOUBLE:
        return got is ValueType.DOUBLE and not math.isnan(value)
    return got is kind
