"""Queries for what the engine does to its state: transactions, sets of rows, logs, snapshots, views and streams.

Each makes its changes to the star-schema tables, taken as an engine's stored rows,
and returns the state that results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .changes import ChangeSet
from .engine import CommitResult, Engine
from .errors import ConstraintError
from .functions.predicates import FieldRef
from .operators import constraints, relations, rollups
from .plans.view import QuerySpec, ascending, descending
from .queries import BOUND, h
from .schema import SchemaBuilder
from .sources.tables import persisted, read_table, shared_folder
from .streaming.log import LiveLists, LiveRollup
from .types import Index, Stage, ValueType

I, D, S = ValueType.INT64, ValueType.DOUBLE, ValueType.STRING
REGION, NATION, CUSTOMER, NEXT = 100_000_000, 200_000_000, 300_000_000, 400_000_000
TALK, TURN = 10_000_000_000, 20_000_000_000


class Geography:
    """Regions, nations and customers as containers of an engine; ids are made distinct by an offset for each."""

    def __init__(self, s: SparkSession, d: str | None):
        b = SchemaBuilder()
        self.region = b.create_table("Region")
        self.region_name = self.region.add_column("name", S, index=Index.UNIQUE)
        self.nation = b.create_table("Nation")
        self.nation_name = self.nation.add_column("name", S, index=Index.UNIQUE)
        self.in_region = self.nation.add_association("region", self.region.handle)
        self.customer = b.create_table("Customer")
        self.name = self.customer.add_column("name", S)
        self.balance = self.customer.add_column("balance", D, index=Index.NORMAL, default=0.0, nullable=False, check=lambda v: v > -1e9)
        self.segment = self.customer.add_column("segment", S, index=Index.NORMAL, default="NONE")
        self.twice = self.customer.add_computed_column("twice", D, [self.balance], compute=lambda v: 2 * v, compute_sql="2 * balance")
        self.in_nation = self.customer.add_association("nation", self.nation.handle)
        base = None
        if d is not None:
            row = lambda table, key, **columns: read_table(s, d, table).select((F.col(key) + F.lit(_OFFSETS[table])).cast("bigint").alias("item_id"), F.lit(None).cast("string").alias("variant"), F.lit(None).cast("bigint").alias("list_index"), *[F.expr(e).alias(c) for c, e in columns.items()])
            base = {
                "Region": row("region", "r_regionkey", name="r_name"),
                "Nation": row("nation", "n_nationkey", name="n_name", region=f"cast(n_regionkey + {REGION} as bigint)"),
                "Customer": row("customer", "c_custkey", name="c_name", balance="c_acctbal", segment="c_mktsegment", twice="2 * c_acctbal", nation=f"cast(c_nationkey + {NATION} as bigint)"),
            }
        self.e = Engine(s, b.freeze(), base, NEXT)

    def customers(self, *columns: str) -> DataFrame:
        return self.e.frame(self.customer.handle).select("item_id", *columns)


_OFFSETS = {"region": REGION, "nation": NATION, "customer": CUSTOMER}


@query
def txn_insert(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    with g.e.transaction() as t:
        r = t.insert(g.region.handle, {g.region_name: "ATLANTIS"})
        t.insert(g.nation.handle, {g.nation_name: "LEMURIA", g.in_region: r})
    return g.e.frame(g.nation.handle).select("item_id", "name", "region")


@query
def txn_update_cell(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    with g.e.transaction() as t:
        t.update(CUSTOMER + 5, g.balance, 1.5)
    return g.customers("balance", "twice")


@query
def txn_update_cells(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    with g.e.transaction() as t:
        t.update(CUSTOMER + 7, {g.balance: 2.0, g.segment: "OTHER"})
    return g.customers("balance", "segment", "twice")


@query
def txn_remove_cascade(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    with g.e.transaction() as t:
        t.remove(NATION + 3)
    return g.e.frame(g.nation.handle).select("item_id").union(g.customers())


@query
def txn_rollback(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    t = g.e.begin()
    t.insert(g.region.handle, {g.region_name: "ATLANTIS"})
    t.update(CUSTOMER + 5, g.balance, 1.5)
    t.remove(CUSTOMER + 6)
    t.rollback()
    return g.customers("balance")


@query
def txn_failure(s: SparkSession, d: str) -> DataFrame:
    """A unique name that is taken undoes what came before it."""
    g = Geography(s, d)
    t = g.e.begin()
    t.update(CUSTOMER + 5, g.balance, 1.5)
    try:
        t.insert(g.region.handle, {g.region_name: g.e.read(REGION + 1, g.region_name)})
    except ConstraintError:
        t.rollback()
    return g.customers("balance").withColumn("state", F.lit(t.state.value))


def _three_updates(g: Geography) -> None:
    for value in (1.5, 2.5, 3.5):
        with g.e.transaction() as t:
            t.update(CUSTOMER + 5, g.balance, value)


@query
def txn_undo(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    _three_updates(g)
    g.e.undo()
    g.e.undo()
    return g.customers("balance", "twice")


@query
def txn_redo(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    _three_updates(g)
    for _ in range(3):
        g.e.undo()
    g.e.redo()
    g.e.redo()
    return g.customers("balance", "twice")


@query
def txn_history(s: SparkSession, d: str) -> DataFrame:
    """Steps that can be undone and redone, before and after a commit that takes another way."""
    g = Geography(s, d)
    _three_updates(g)
    g.e.undo()
    rows = [(1, len(g.e.undo_history()), len(g.e.redo_history()))]
    with g.e.transaction() as t:
        t.update(CUSTOMER + 6, g.balance, 9.5)
    rows.append((2, len(g.e.undo_history()), len(g.e.redo_history())))
    with g.e.transaction(undoable=False) as t:
        t.update(CUSTOMER + 6, g.balance, 8.5)
    rows.append((3, len(g.e.undo_history()), len(g.e.redo_history())))
    return s.createDataFrame(rows, "at int, undo int, redo int")


@query
def bulk_insert(s: SparkSession, d: str) -> DataFrame:
    """A customer for each nation, with defaults and a computed column."""
    g = Geography(s, d)
    rows = read_table(s, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + F.lit(NATION)).cast("bigint").alias("nation"))
    g.e.insert_many(g.customer.handle, rows, ["name"])
    return g.customers("name", "balance", "segment", "twice", "nation").where(F.col("item_id") >= NEXT)


@query
def bulk_update(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    g.e.update_many(g.customer.handle, g.customers("balance", "segment").where("segment = 'BUILDING'").select("item_id", (F.col("balance") + 100).alias("balance")))
    return g.customers("balance", "segment", "twice")


@query
def bulk_remove_cascade(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    g.e.remove_many(s.createDataFrame([(REGION + 1,), (NATION + 2,)], "item_id bigint"))
    return g.e.frame(g.nation.handle).select("item_id").union(g.customers())


@query
def engine_read(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    rows = [(i, g.e.contains(i), g.e.read(i, g.balance) if g.e.contains(i) else None) for i in (CUSTOMER + 5, CUSTOMER + 1_000_000_000)]
    return s.createDataFrame(rows, "item_id bigint, there boolean, balance double")


@query
def list_transactions(s: SparkSession, d: str) -> DataFrame:
    """A group of conversation turns after an insertion, a removal and a rotation."""
    b = SchemaBuilder()
    talk = b.create_table("Talk")
    turn = b.create_list("Turn")
    role = turn.add_column("role", S, index=Index.NORMAL)
    turn.set_association("talk", talk.handle)
    rows = read_table(s, d, "conversations")
    none = F.lit(None).cast("string").alias("variant")
    talks = rows.select((F.col("conv_id") + F.lit(TALK)).alias("item_id")).distinct().select("item_id", none, F.lit(None).cast("bigint").alias("list_index"))
    turns = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), none, F.col("turn").alias("list_index"), "role", (F.col("conv_id") + F.lit(TALK)).alias("talk"))
    e = Engine(s, b.freeze(), {"Talk": talks, "Turn": turns}, TURN)
    with e.transaction() as t:
        t.insert(turn.handle, TALK + 3, 1, {role: "note"})
        t.remove_at(turn.handle, TALK + 3, 0)
        t.rotate(turn.handle, TALK + 3, 0, 3, 1)
    return e.frame(turn.handle).where(F.col("talk") == TALK + 3).select("item_id", "list_index", "role")


@query
def snapshot_round_trip(s: SparkSession, d: str) -> DataFrame:
    g = Geography(s, d)
    with g.e.transaction() as t:
        t.update(CUSTOMER + 5, g.balance, 1.5)
        t.remove(CUSTOMER + 6)
    folder = shared_folder(s)
    g.e.create_snapshot(folder)
    other = Geography(s, None)
    other.e.restore_snapshot(folder)
    return other.customers("name", "balance", "nation")


@query
def log_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Two commits appended to a log and replayed on an engine that hasn't seen them."""
    g, folder = Geography(s, d), shared_folder(s)
    for n, value in enumerate((1.5, 2.5)):
        t = g.e.begin()
        t.update(CUSTOMER + 5 + n, g.balance, value)
        t.insert(g.customer.handle, {g.name: f"new {n}", g.in_nation: NATION + 1})
        g.e.append_log(t.commit(), folder, n)
    other = Geography(s, d)
    other.e.replay_log(folder)
    return other.customers("name", "balance", "segment", "twice")


@query
def change_set_codec(s: SparkSession, d: str) -> DataFrame:
    """A transaction's change set through bytes, and merged, on an engine that hasn't seen it."""
    g = Geography(s, d)
    t = g.e.begin()
    t.update(CUSTOMER + 5, g.balance, 1.5)
    t.update(CUSTOMER + 5, g.balance, 4.5)
    t.remove(CUSTOMER + 6)
    done: CommitResult = t.commit()
    other = Geography(s, d)
    other.e.replay(ChangeSet.merge([ChangeSet.deserialize(done.change_set.serialize())]))
    return other.customers("balance", "twice")


@query
def txn_hooks(s: SparkSession, d: str) -> DataFrame:
    """A hook that fills another cell of the row that is being written, before computed columns."""
    b = SchemaBuilder()
    item = b.create_table("Item")
    value, mirror = item.add_column("value", I, index=Index.NORMAL), item.add_column("mirror", I, index=Index.NORMAL)
    item.add_computed_column("total", I, [value, mirror], compute=lambda a, b: (a or 0) + (b or 0))

    def fill(context, change):
        for o in change.operations:
            new = o.item.values.get("value") if o.item is not None else o.new if o.column == "value" else None
            if new is not None:
                context.update(o.item_id, mirror, 2 * new)

    item.add_hook(Stage.BEFORE_APPLY, fill)
    e = Engine(s, b.freeze())
    keys = [r.n_nationkey for r in read_table(s, d, "nation").select("n_nationkey").orderBy("n_nationkey").limit(5).collect()]
    with e.transaction() as t:
        made = [t.insert(item.handle, {value: k}) for k in keys]
    with e.transaction() as t:
        t.update(made[0], value, 50)
    return e.frame(item.handle).select("item_id", "value", "mirror", "total")


@query
def txn_events(s: SparkSession, d: str) -> DataFrame:
    """The events of a commit, an undo and a rollback, to a subscriber that leaves before the last transaction."""
    g, seen = Geography(s, d), []
    sub = g.e.subscribe(lambda e: seen.append((len(seen), e.stage.value, e.origin.value, len(e.change_set.operations))))
    with g.e.transaction() as t:
        t.update(CUSTOMER + 5, g.balance, 1.5)
    g.e.undo()
    g.e.begin().rollback()
    sub.disconnect()
    with g.e.transaction() as t:
        t.update(CUSTOMER + 5, g.balance, 2.5)
    return s.createDataFrame(seen, "at int, stage string, origin string, operations int")


# views


def _customers(s: SparkSession, d: str, *sort):
    return BOUND.view(s, d, "customer", QuerySpec(sort=sort))


@query
def view_live(s: SparkSession, d: str) -> DataFrame:
    """A view made before a transaction sees what it did."""
    g = Geography(s, d)
    view = g.e.view(g.customer.handle)
    before = view.count()
    with g.e.transaction() as t:
        t.insert(g.customer.handle, {g.name: "new", g.in_nation: NATION})
    return s.createDataFrame([(before, view.count())], "before bigint, after bigint")


@query
def view_count(s: SparkSession, d: str) -> DataFrame:
    rows = _customers(s, d)
    return s.createDataFrame([(rows.count(), rows.offset(100).count(), rows.offset(100).limit(7).count())], "n bigint, after_offset bigint, within_limit bigint")


@query
def view_empty(s: SparkSession, d: str) -> DataFrame:
    rows = _customers(s, d)
    return s.createDataFrame([(rows.empty(), rows.limit(0).empty(), rows.offset(1_000_000_000).empty())], "rows boolean, none boolean, past_end boolean")


@query
def view_sort(s: SparkSession, d: str) -> DataFrame:
    """Sorted twice: the later sort comes first, ties by the earlier."""
    rows = _customers(s, d, ascending(h["customer.c_acctbal"])).sort(descending(h["customer.c_mktsegment"]))
    return rows.positioned("pos").select(F.col("item_id").alias("c_custkey"), "pos")


@query
def view_offset(s: SparkSession, d: str) -> DataFrame:
    """An offset without a limit leaves nearly all rows."""
    return _customers(s, d, descending(h["customer.c_acctbal"])).offset(100).dataframe().select(F.col("item_id").alias("c_custkey"))


@query
def view_rows(s: SparkSession, d: str) -> DataFrame:
    rows = _customers(s, d, descending(h["customer.c_acctbal"])).limit(20).to_rows()
    return s.createDataFrame([(i, r.item_id, r.c_acctbal) for i, r in enumerate(rows)], "pos bigint, c_custkey bigint, c_acctbal double")


@query
def view_visit(s: SparkSession, d: str) -> DataFrame:
    """A visitor that stops at the first negative balance of the first 1000 customers."""
    seen = []

    def visit(row):
        seen.append((row.item_id, row.c_acctbal))
        return row.c_acctbal >= 0

    _customers(s, d).limit(1000).for_each(visit)
    return s.createDataFrame(seen, "c_custkey bigint, c_acctbal double")


@query
def view_aggregate_rows(s: SparkSession, d: str) -> DataFrame:
    rows = _customers(s, d).aggregate("count", group_by=h["customer.c_mktsegment"]).to_rows()
    return s.createDataFrame([(r.group_key, r.value) for r in rows], "c_mktsegment string, n bigint")


# rules as queries


def _events(s: SparkSession, d: str, **columns: str) -> DataFrame:
    """Events as rows of a container with the variants purchase and view (others have none)."""
    none = {"variant": "case when event_type in ('purchase', 'view') then event_type end", "list_index": "cast(null as bigint)"}
    return read_table(s, d, "events").select(F.col("event_id").alias("item_id"), *[F.expr(e).alias(c) for c, e in (none | columns).items()])


@query
def chk_not_null(s: SparkSession, d: str) -> DataFrame:
    b = SchemaBuilder()
    t = b.create_table("Event")
    t.add_column("v", D, nullable=False)
    rows = _events(s, d, v="case when event_type = 'purchase' then value end", variant="cast(null as string)")
    return constraints.violations(rows, b.freeze().containers[0]).select("rule", F.col("column").alias("field"), "item_id")


@query
def chk_unique_nulls(s: SparkSession, d: str) -> DataFrame:
    """Values that rows share, null as one of them."""
    rows = _events(s, d, v="case when event_type = 'purchase' then cast(floor(value) as bigint) end")
    return constraints.duplicates(rows, ["v"], nulls_count=True)


@query
def chk_variant_rules(s: SparkSession, d: str) -> DataFrame:
    """How often each rule on variants is broken: a variant that isn't there, a cell of another variant, a value that is unique within its variant."""
    b = SchemaBuilder()
    t = b.create_table("Event")
    purchase = t.add_variant("purchase")
    t.add_variant("view")
    t.add_variant_column(purchase, "amount", I, index=Index.UNIQUE, nullable=False)
    rows = _events(s, d, amount="case when event_type in ('purchase', 'view') and value >= 20 then cast(floor(value) as bigint) end")
    found = constraints.violations(rows, b.freeze().containers[0])
    return found.groupBy("rule", F.col("column").alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query
def chk_python(s: SparkSession, d: str) -> DataFrame:
    """A check that has no SQL, over a set of rows."""
    b = SchemaBuilder()
    b.create_table("Customer").add_column("balance", D, check=lambda v: v > 0)
    rows = read_table(s, d, "customer").select(F.col("c_custkey").alias("item_id"), F.lit(None).cast("string").alias("variant"), F.col("c_acctbal").alias("balance"))
    return constraints.violations(rows, b.freeze().containers[0]).select("rule", F.col("item_id").alias("c_custkey"))


@query
def chk_against_stored(s: SparkSession, d: str) -> DataFrame:
    """New rows whose unique value is stored already, or whose parent isn't there."""
    g = Geography(s, d)
    info = g.e.schema.info(g.nation.handle)
    new = read_table(s, d, "nation").select((F.col("n_nationkey") + NEXT).cast("bigint").alias("item_id"), F.lit(None).cast("string").alias("variant"), F.expr("case when n_nationkey % 2 = 0 then n_name else concat('NEW ', n_name) end").alias("name"), F.expr(f"cast(case when n_nationkey % 3 = 0 then 1 else n_regionkey + {REGION} end as bigint)").alias("region"))
    found = constraints.violations(new, info, {"region": g.e.frame(g.region.handle)}, g.e.frame(g.nation.handle))
    return found.select("rule", F.col("column").alias("field"), "item_id")


@query
def chk_cycles(s: SparkSession, d: str) -> DataFrame:
    """Of customers in chains of five, those of every other chain, which is closed."""
    k = F.col("c_custkey")
    parent = F.when(k % 5 != 4, k + 1).when(k % 10 == 4, k - 4)
    return relations.cyclic(read_table(s, d, "customer").select(k.alias("id"), parent.alias("parent")))


# maintained aggregates and streams


@query
def rollup_maintained(s: SparkSession, d: str) -> DataFrame:
    """Sums, minima and maxima by customer, kept as partial rows of two halves of the orders."""
    rows = BOUND.frame(s, d, "orders")
    halves = [rollups.rollup(rows.where(F.col("o_orderkey") % 2 == n), "o_custkey", "o_orderkey") for n in (0, 1)]
    kept = persisted(rollups.merge_rollups(*halves))
    return kept.select(F.col("parent").alias("o_custkey"), "n", F.col("total").cast("bigint").alias("total"), "lo", "hi")


@query
def stream_rollup(s: SparkSession, d: str) -> DataFrame:
    """The same over a stream of orders in several batches; whole numbers stay exact."""
    source, checkpoint = shared_folder(s), shared_folder(s)
    rows = read_table(s, d, "orders").select(F.col("o_custkey").alias("parent"), (F.col("o_orderkey") + F.lit(1 << 53)).alias("value"))
    live = LiveRollup(s, kind="bigint")
    for n in (0, 1):
        rows.where(F.col("value") % 2 == n).write.mode("append").parquet(source)
        live.start(s.readStream.schema(rows.schema).parquet(source), checkpoint).awaitTermination()
    return live.read().select(F.col("parent").alias("o_custkey"), "n", F.col("total").cast("string").alias("total"), "lo", "hi")


@query
def stream_lists(s: SparkSession, d: str) -> DataFrame:
    """Lists built by a stream: turns are inserted at the front, and then the first of each list is rotated to the end."""
    source, checkpoint = shared_folder(s), shared_folder(s)
    none = F.lit(None).cast("bigint")
    turns = read_table(s, d, "conversations")
    rows = [
        turns.select(F.col("turn").cast("bigint").alias("seq"), F.col("conv_id").cast("bigint").alias("grp"), F.lit("insert").alias("op"), (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("item"), F.lit(0).cast("bigint").alias("at"), none.alias("cnt"), none.alias("off")),
        turns.groupBy(F.col("conv_id").cast("bigint").alias("grp")).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(1_000_000).cast("bigint").alias("seq"), "grp", F.lit("rotate").alias("op"), none.alias("item"), F.lit(0).cast("bigint").alias("at"), "cnt", F.lit(1).cast("bigint").alias("off")),
    ]
    live = LiveLists(s)
    for r in rows:
        r.write.mode("append").parquet(source)
        live.start(s.readStream.schema(rows[0].schema).parquet(source), checkpoint).awaitTermination()
    return live.read().select(F.col("grp").alias("conv_id"), F.col("item").alias("item_id"), "list_index")


@query
def variant_field(s: SparkSession, d: str) -> DataFrame:
    """The field of a variant: null where it doesn't apply; sorted by it, null is the lowest."""
    rows = BOUND.view(s, d, "events", QuerySpec(sort=(ascending(FieldRef.variant(h["events.purchase"])), descending(h["events.amount"]))))
    return rows.positioned("pos").select(F.col("item_id").alias("event_id"), "pos")
