"""The engine's state: base tables that Spark reads, and an overlay of changed rows on the driver."""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import Item
from .schema import ContainerInfo, Schema
from .types import Kind


#: Ids of changed rows that are broadcast, at most.
MAX_BROADCAST = 1_000_000
#: Ids that a filter lists, at most; more are joined.
MAX_LISTED = 200


class Store:
    """Rows by id. ``base`` has a DataFrame for containers with stored rows; the overlay has rows that
    differ from it, None for removed ones, and is folded into the base by ``compacted``."""

    def __init__(self, spark: SparkSession, schema: Schema, base: dict[int, DataFrame] | None = None):
        self.spark, self.schema, self.base = spark, schema, dict(base or {})
        self.overlay: dict[int, Item | None] = {}
        self._home: dict[int, int] = {}  # container of overlay ids
        self._groups: dict[tuple[int, object], list[int]] = {}
        self._children: dict[int, set[int]] = defaultdict(set)
        self._values: dict[tuple, set[int]] = defaultdict(set)
        self._ahead: dict[int, Item | None] = {}  # stored rows read ahead of single reads

    def info(self, container: int) -> ContainerInfo:
        return self.schema.containers[container]

    def parent_id(self, item: Item):
        p = self.info(item.container).parent
        return None if p is None else item.values.get(p.name)

    def find(self, item_id: int) -> Item | None:
        return self.find_many([item_id]).get(item_id)

    def find_many(self, ids: list[int]) -> dict[int, Item | None]:
        """Items by id, None or absent where there is none; one job looks for the containers, and one reads rows from each."""
        out = {i: self.overlay[i] for i in ids if i in self.overlay}
        out |= {i: self._ahead[i] for i in ids if i not in out and i in self._ahead}
        sought = [i for i in ids if i not in out]
        if sought and self.base:
            homes = list(self.base)
            if len(homes) > 1:
                where = reduce(DataFrame.union, (self._among(df, "item_id", sought).select(F.lit(c).alias("c")) for c, df in self.base.items()))
                homes = sorted({r.c for r in where.distinct().collect()})
            for c in homes:
                out |= {r.item_id: self._item(c, r) for r in self._among(self.base[c], "item_id", sought).collect()}
        return out

    def _among(self, df: DataFrame, column: str, ids: list[int]) -> DataFrame:
        """Rows that have one of some ids in a column."""
        if len(ids) <= MAX_LISTED:
            return df.where(F.col(column).isin(ids))
        return df.join(self._id_table(ids).withColumnRenamed("item_id", "_sought"), F.col(column) == F.col("_sought"), "left_semi")

    def _id_table(self, ids: list[int]) -> DataFrame:
        out = self.spark.createDataFrame([(i,) for i in ids], "item_id bigint")
        return F.broadcast(out) if len(ids) <= MAX_BROADCAST else out

    @contextmanager
    def ahead(self, ids: list[int]):
        """Within, single reads of these ids start no jobs of their own: what is stored of them is read at once."""
        new = [i for i in dict.fromkeys(ids) if i not in self.overlay and i not in self._ahead]
        found = self.find_many(new) if new else {}
        self._ahead.update((i, found.get(i)) for i in new)
        try:
            yield
        finally:
            for i in new:
                self._ahead.pop(i, None)

    def _item(self, container: int, row) -> Item:
        info = self.info(container)
        values = {c.name: row[c.name] for c in info.columns if row[c.name] is not None}
        return Item(row.item_id, container, {k: bytes(v) if isinstance(v, bytearray) else int(v) if hasattr(v, "as_tuple") else v for k, v in values.items()}, row.variant, row.list_index)

    def put(self, item: Item) -> None:
        self._unlist(item.id)
        self.overlay[item.id] = item
        self._home[item.id] = item.container
        p = self.parent_id(item)
        if p is not None:
            self._children[p].add(item.id)
        for name, v in item.values.items():
            self._values[item.container, name, v].add(item.id)

    def drop(self, item: Item) -> None:
        self._unlist(item.id)
        self._home[item.id] = item.container
        self.overlay[item.id] = None

    def _unlist(self, item_id: int) -> None:
        old = self.overlay.get(item_id)
        if old is not None:
            p = self.parent_id(old)
            if p is not None:
                self._children[p].discard(item_id)
            for name, v in old.values.items():
                self._values[old.container, name, v].discard(item_id)

    def children(self, parents: list[int]) -> list[int]:
        """Ids whose parent is one of these, ascending."""
        found = {c for p in parents for c in self._children.get(p, ())}
        for c, df in self.base.items():
            rel = self.info(c).parent
            if rel is not None:
                found |= {r.item_id for r in self._among(df, rel.name, list(parents)).select("item_id").collect() if r.item_id not in self.overlay}
        return sorted(found)

    def with_value(self, container: int, column: str, value, others: dict[str, object]) -> list[Item]:
        """Rows with a value in a column and equal cells in ``others`` (columns or variant): all of the overlay, and one at least of the base if there are any."""
        fits = lambda i: all((i.variant if k == "variant" else i.values.get(k)) == v for k, v in others.items())
        if value is None:
            found = [i for i in self.overlay.values() if i and i.container == container and i.values.get(column) is None]
        else:
            found = [self.overlay[i] for i in self._values.get((container, column, value), ())]
        found = [i for i in found if fits(i)]
        if container in self.base:
            rows = self.base[container].where(F.col(column).eqNullSafe(F.lit(value)))
            for k, v in others.items():
                rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
            changed = sum(home == container for home in self._home.values())
            found += [self._item(container, r) for r in rows.limit(changed + 2).collect() if r.item_id not in self.overlay]
        return found

    def group(self, container: int, key) -> list[int]:
        """The ids of a list's group in order, read once and kept in step from then on."""
        if (container, key) not in self._groups:
            ids: list[int] = []
            if container in self.base and key is not None:
                name = self.info(container).columns[self.info(container).association].name
                rows = self.base[container].where(F.col(name) == key).orderBy("list_index").select("item_id").collect()
                ids = [r.item_id for r in rows if r.item_id not in self.overlay]
            self._groups[container, key] = ids
        return self._groups[container, key]

    def renumber(self, container: int, key, start: int = 0) -> None:
        ids = self.group(container, key)[start:]
        known = self.find_many(ids)
        for i, item_id in enumerate(ids, start):
            item = known[item_id]
            if item.list_index != i:
                item = item.copy()
                item.list_index = i
                self.put(item)

    def frame(self, container: int) -> DataFrame:
        """All rows of a container at this moment."""
        info = self.info(container)
        own = [i for i in self.overlay.values() if i is not None and i.container == container]
        rows = [(i.id, i.variant, i.list_index if info.kind is Kind.LIST else None, *(_cell(c, i.values.get(c.name)) for c in info.columns)) for i in own]
        now = self.spark.createDataFrame(rows, info.struct)
        if container not in self.base:
            return now
        changed = [i for i, home in self._home.items() if home == container]
        old = self.base[container]
        if changed:
            old = old.join(self._id_table(changed), "item_id", "left_anti").select(*info.struct.names)
        return old.unionByName(now) if rows else old

    def rebase(self, container: int, rows: DataFrame) -> None:
        """Takes ``rows`` for all rows of a container; what the overlay has of it is dropped."""
        self.base[container] = rows.select(*self.info(container).struct.names)
        self._ahead.clear()
        for i in [i for i, home in self._home.items() if home == container]:
            self._unlist(i)
            del self._home[i], self.overlay[i]
        self._groups = {k: v for k, v in self._groups.items() if k[0] != container}

    def changed(self, container: int) -> bool:
        return any(home == container for home in self._home.values())

    def count_overlay(self) -> int:
        return len(self.overlay)


def _cell(column, v):
    from decimal import Decimal

    return Decimal(v) if v is not None and column.target is None and column.spark_type.typeName() == "decimal" else v
