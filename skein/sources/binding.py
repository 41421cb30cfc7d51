"""The star-schema tables as containers of a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.view import QuerySpec, View
from ..schema import ContainerInfo, Schema, SchemaBuilder
from ..types import Index, ValueType
from .tables import read_table

N = Index.NORMAL
I, D, S = ValueType.INT64, ValueType.DOUBLE, ValueType.STRING
EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


class Bound:
    """A schema over Parquet tables: views read them where they lie, columns under the schema's names."""

    def __init__(self):
        b = SchemaBuilder()
        self._how: dict[str, tuple[str, dict[str, str]]] = {}
        self.h: dict[str, object] = {}

        region = self._table(b, "region", "region", {"item_id": "cast(r_regionkey as bigint)"}, r_name=S)
        nation = self._table(b, "nation", "nation", {"item_id": "cast(n_nationkey as bigint)", "n_regionkey": "cast(n_regionkey as bigint)"}, n_name=S)
        self._parent(nation, "nation", "n_regionkey", region)
        customer = self._table(b, "customer", "customer", {"item_id": "c_custkey", "c_nationkey": "cast(c_nationkey as bigint)", "c_in_debt": "c_acctbal < 0", "c_tag": "cast(c_mktsegment as binary)"}, c_name=S, c_acctbal=D, c_mktsegment=S, c_in_debt=ValueType.BOOL, c_tag=ValueType.BINARY)
        self._parent(customer, "customer", "c_nationkey", nation)
        part = self._table(b, "part", "part", {"item_id": "p_partkey", "p_size": "cast(p_size as bigint)"}, p_size=I, p_retailprice=D)
        part.add_range_index([self.h["part.p_size"], self.h["part.p_retailprice"]])
        orders = self._table(b, "orders", "orders", {"item_id": "o_orderkey"}, o_orderkey=I, o_orderstatus=S, o_totalprice=D, o_orderpriority=S)
        self._parent(orders, "orders", "o_custkey", customer)
        events = b.create_table("events")
        self._how["events"] = ("events", {"item_id": "event_id", "variant": "event_type", "v": "case when event_type = 'purchase' then value end", "amount": "case when event_type = 'purchase' then value end", "at": "unix_micros(cast(ts as timestamp))", "s": "cast(floor(value) as bigint)", "t": "cast(floor(value) as bigint) + 20"})
        for name in EVENT_TYPES:
            self.h[f"events.{name}"] = events.add_variant(name)
        self.h["events.value"] = events.add_column("value", D, index=N)
        self.h["events.v"] = events.add_column("v", D, index=N)
        self.h["events.amount"] = events.add_variant_column(self.h["events.purchase"], "amount", D, index=N)
        self.h["events.at"] = events.add_column("at", I, index=N)
        self.h["events.s"] = events.add_column("s", I)
        self.h["events.t"] = events.add_column("t", I)
        self._parent(events, "events", "user_id", customer)
        events.add_ordered_index([self.h["events.at"]], [self.h["events.user_id"]])
        events.add_interval_index(self.h["events.s"], self.h["events.t"], [self.h["events.user_id"]])
        conversations = b.create_list("conversations")
        talk = b.create_table("conversation")
        self._how["conversations"] = ("conversations", {"item_id": "conv_id * 1000 + turn", "list_index": "turn", "turn": "turn"})
        self.h["conversations.turn"] = conversations.add_column("turn", I, index=N)
        self.h["conversations.role"] = conversations.add_column("role", S, index=N)
        self.h["conversations.conv_id"] = conversations.set_association("conv_id", talk.handle)
        talk.add_column("topic", S)
        self.h |= {x.name: x.handle for x in (region, nation, customer, part, orders, events, conversations)}
        self.schema: Schema = b.freeze()

    def _table(self, b: SchemaBuilder, name: str, file: str, how: dict[str, str], **columns: ValueType):
        made = b.create_table(name)
        self._how[name] = (file, how)
        for c, kind in columns.items():
            self.h[f"{name}.{c}"] = made.add_column(c, kind, index=N)
        return made

    def _parent(self, made, name: str, column: str, target) -> None:
        self.h[f"{name}.{column}"] = made.add_association(column, target.handle)

    def info(self, name: str) -> ContainerInfo:
        return self.schema.info(self.h[name])

    def frame(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        file, how = self._how[name]
        info = self.info(name)
        how = {"variant": "cast(null as string)", "list_index": "cast(null as bigint)"} | how
        columns = ["item_id", "variant", "list_index", *(c.name for c in info.columns)]
        return read_table(spark, folder, file).select(*[F.expr(how.get(c, c)).alias(c) for c in columns])

    def view(self, spark: SparkSession, folder: str, name: str, spec: QuerySpec = QuerySpec()) -> View:
        return View.query(lambda: self.frame(spark, folder, name), self.schema, self.info(name), spec)
