"""The engine's queries over the star-schema tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import QUERIES
from .catalogue import query as _query
from .functions.predicates import EVERYTHING, Expr, FieldRef, all_of, any_of, negate, where
from .operators import changelog, constraints, intervals, lists, neighbors, relations
from .plans.view import QuerySpec, View, ascending, descending
from .sources.binding import Bound
from .sources.tables import read_table

BOUND = Bound()
h = BOUND.h


def _view(s: SparkSession, d: str, name: str, e: Expr = EVERYTHING, *sort) -> View:
    return BOUND.view(s, d, name, QuerySpec(e, sort))


def _filter(name: str, table: str, e: Expr, **columns: str) -> None:
    """A filter query that returns some columns, by name in the result."""
    QUERIES[name] = lambda s, d: _view(s, d, table, e).select(*[F.col(c).alias(a) for a, c in columns.items()])


@_query
def flagship(s: SparkSession, d: str) -> DataFrame:
    e = all_of(where(h["orders.o_orderstatus"], "=", "F"), where(h["orders.o_totalprice"], ">", 1000.0), negate(where(h["orders.o_orderpriority"], "=", "1-URGENT")))
    return _view(s, d, "orders", e, descending(h["orders.o_totalprice"])).limit(10).dataframe().select("o_orderkey", "o_custkey", "o_totalprice")


@_query
def scan_table(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "nation").select(F.col("item_id").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@_query
def scan_list_default(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "conversations").positioned().select("conv_id", "turn", "pos")


@_query
def scan_list_group(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "conversations", where(h["conversations.conv_id"], "=", 3)).dataframe().select("turn", "role")


@_query
def point_read(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "orders", where(FieldRef.id(), "=", 7)).select("o_orderkey", "o_totalprice")


@_query
def list_length(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "conversations").aggregate("count", group_by=h["conversations.conv_id"]).dataframe("n", "conv_id")


_filter("flt_eq", "customer", where(h["customer.c_mktsegment"], "=", "BUILDING"), c_custkey="item_id")
_filter("flt_ne", "customer", where(h["customer.c_mktsegment"], "!=", "BUILDING"), c_custkey="item_id")
_filter("flt_gt", "customer", where(h["customer.c_acctbal"], ">", 5000.0), c_custkey="item_id")
_filter("flt_lt", "customer", where(h["customer.c_acctbal"], "<", 0.0), c_custkey="item_id")
_filter("flt_ge", "part", where(h["part.p_size"], ">=", 40), p_partkey="item_id")
_filter("flt_le", "part", where(h["part.p_size"], "<=", 5), p_partkey="item_id")
_filter("flt_bool_ne", "customer", where(h["customer.c_in_debt"], "!=", False), c_custkey="item_id")
_filter("flt_binary_eq", "customer", where(h["customer.c_tag"], "=", b"BUILDING"), c_custkey="item_id")
_size, _price = h["part.p_size"], h["part.p_retailprice"]
_filter("flt_and_range", "part", all_of(where(_size, ">", 10), where(_size, "<", 30), where(_price, ">=", 920.0), where(_price, "<=", 980.0)), p_partkey="item_id")
_filter("flt_or", "part", any_of(where(_size, "<", 3), where(_price, "<", 950.0)), p_partkey="item_id")
_filter("flt_not", "part", negate(where(_size, "<", 25)), p_partkey="item_id")
_status, _total = h["orders.o_orderstatus"], h["orders.o_totalprice"]
_filter("flt_mixed", "orders", all_of(any_of(where(_status, "=", "F"), where(_status, "=", "P")), negate(where(_total, ">", 50000.0))), o_orderkey="o_orderkey")
_v, _amount = h["events.v"], h["events.amount"]
_filter("flt_null_lt", "events", where(_v, "<", 50.0), event_id="item_id")
_filter("flt_null_gt", "events", where(_v, ">", 50.0), event_id="item_id")
_filter("flt_null_ne", "events", where(_v, "!=", 50.0), event_id="item_id")
_filter("flt_null_eq_null", "events", where(_v, "=", None), event_id="item_id")
_filter("var_pred", "events", where(_amount, ">", 50.0), event_id="item_id")
_filter("var_not_pred", "events", negate(where(_amount, ">", 50.0)), event_id="item_id")


@_query
def flt_match_all(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "orders").aggregate("count").dataframe("n")


@_query
def flt_chain_after_limit(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "events").limit(500).filter(where(h["events.value"], ">", 50.0)).select(F.col("item_id").alias("event_id"))


@_query
def sort_desc_tie_id(s: SparkSession, d: str) -> DataFrame:
    rows = _view(s, d, "customer", EVERYTHING, descending(h["customer.c_nationkey"])).limit(20)
    return View(rows.dataframe, BOUND.schema, BOUND.info("customer"), (), rows._order).positioned("rn").select(F.col("item_id").alias("c_custkey"), (F.col("rn") + 1).alias("rn"))


@_query
def sort_nulls_lowest(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "events", EVERYTHING, ascending(_v)).positioned("rn").select(F.col("item_id").alias("event_id"), (F.col("rn") + 1).alias("rn"))


@_query
def topk(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "orders", EVERYTHING, descending(_total)).limit(25).dataframe().select("o_orderkey", "o_totalprice")


@_query
def offset_limit(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "orders").limit(10).offset(20).dataframe().select("o_orderkey")


@_query
def agg_count(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "events").aggregate("count").dataframe("n")


@_query
def agg_sum(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "orders").aggregate("sum", h["orders.o_orderkey"]).dataframe("s")


@_query
def agg_min_max(s: SparkSession, d: str) -> DataFrame:
    balance = h["customer.c_acctbal"]
    return _view(s, d, "customer").aggregates(("min", balance), ("max", balance)).dataframe("lo", "hi")


@_query
def agg_count_by_parent(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "orders").aggregate("count", group_by=h["orders.o_custkey"]).dataframe("n", "o_custkey")


@_query
def agg_sum_by_parent(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "orders").aggregate("sum", _total, h["orders.o_custkey"]).dataframe("s", "o_custkey").withColumn("s", F.round("s", 2))


@_query
def agg_max_by_variant(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "events").aggregate("max", h["events.value"], FieldRef.variant(h["events.purchase"])).dataframe("m", "event_type")


@_query
def agg_parent_selection(s: SparkSession, d: str) -> DataFrame:
    parent = h["nation.n_regionkey"]
    e = any_of(*(where(parent, "=", k) for k in (1, 2, 2)))
    return _view(s, d, "nation", e).aggregate("count", group_by=parent).dataframe("n", "n_regionkey").withColumn("n_regionkey", F.col("n_regionkey").cast("int"))


@_query
def agg_over_limited(s: SparkSession, d: str) -> DataFrame:
    rows = _view(s, d, "events").offset(50).limit(100)
    return rows.aggregates(("count",), ("sum", h["events.value"])).dataframe("n", "s").withColumn("s", F.round("s", 2))


@_query
def agg_null_min_lowest(s: SparkSession, d: str) -> DataFrame:
    return _view(s, d, "events").aggregate("min", _v, FieldRef.variant(h["events.purchase"])).dataframe("m", "event_type")


@_query
def rel_fk_selection(s: SparkSession, d: str) -> DataFrame:
    return relations.children_of(BOUND.frame(s, d, "orders"), "o_custkey", [1, 2]).select("o_orderkey")


@_query
def rel_join_parent(s: SparkSession, d: str) -> DataFrame:
    o = _view(s, d, "orders", where(_total, ">", 200000.0)).select("o_orderkey", "o_custkey")
    c = _view(s, d, "customer").select(F.col("item_id").alias("c_id"), "c_name", "c_nationkey")
    n = _view(s, d, "nation").select(F.col("item_id").alias("n_id"), "n_name")
    return relations.with_parent(relations.with_parent(o, c, "o_custkey", "c_id"), n, "c_nationkey", "n_id").select("o_orderkey", "c_name", "n_name")


@_query
def rel_semi(s: SparkSession, d: str) -> DataFrame:
    o = _view(s, d, "orders", where(_total, ">", 200000.0)).select("o_custkey")
    return relations.having_children(BOUND.frame(s, d, "customer"), o, "item_id", "o_custkey").select(F.col("item_id").alias("c_custkey"))


@_query
def rel_anti_referential(s: SparkSession, d: str) -> DataFrame:
    rich = _view(s, d, "customer", where(h["customer.c_acctbal"], ">", 0.0)).select("item_id")
    return relations.dangling(BOUND.frame(s, d, "events").withColumnRenamed("item_id", "event_id"), rich, "user_id", "item_id").select("event_id")


def _edges(s: SparkSession, d: str) -> DataFrame:
    """The hierarchy region, nation, customer, with ids made distinct."""
    r, n, c = (BOUND.frame(s, d, x) for x in ("region", "nation", "customer"))
    one = r.select((F.col("item_id") + 100000000).alias("id"), F.lit(None).cast("bigint").alias("parent"))
    two = n.select(F.col("item_id") + 200000000, F.col("n_regionkey") + 100000000)
    return one.union(two).union(c.select(F.col("item_id") + 300000000, F.col("c_nationkey") + 200000000))


@_query
def rel_descendants(s: SparkSession, d: str) -> DataFrame:
    return relations.descendants(_edges(s, d), [100000001])


@_query
def rel_ancestors(s: SparkSession, d: str) -> DataFrame:
    return relations.ancestors(_edges(s, d), 300000005)


@_query
def nbr_prev_next(s: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbours(BOUND.frame(s, d, "events"), ["user_id"], ["at"]).select(F.col("item_id").alias("event_id"), "prev_id", "next_id")


@_query
def nbr_probe_prev(s: SparkSession, d: str) -> DataFrame:
    rows = BOUND.frame(s, d, "orders")
    return neighbors.as_of(rows, rows, ["o_custkey"], ["o_orderkey"], name="prev_id").select("o_orderkey", "prev_id")


@_query
def nbr_first_k(s: SparkSession, d: str) -> DataFrame:
    return neighbors.first_of_each(BOUND.frame(s, d, "events"), ["user_id"], ["at"], 2).select("user_id", F.col("item_id").alias("event_id"))


@_query
def ivl_pairs(s: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_pairs(BOUND.frame(s, d, "events"), "s", "t", ["user_id"], width=20)


@_query
def ivl_probe(s: SparkSession, d: str) -> DataFrame:
    return intervals.overlapping(BOUND.frame(s, d, "events"), "s", "t", 40, 60, {"user_id": 5}).select(F.col("item_id").alias("event_id"))


@_query
def list_rotate(s: SparkSession, d: str) -> DataFrame:
    return lists.rotate(BOUND.frame(s, d, "conversations"), "conv_id", "turn", 0, 3, 1, "new_index").select("conv_id", "turn", "new_index")


@_query
def list_insert_shift(s: SparkSession, d: str) -> DataFrame:
    return BOUND.frame(s, d, "conversations").select("conv_id", "turn", lists.after_insert(F.col("turn"), 1).alias("new_index"))


@_query
def list_remove_at(s: SparkSession, d: str) -> DataFrame:
    return BOUND.frame(s, d, "conversations").where("turn <> 1").select("conv_id", "turn", lists.after_remove(F.col("turn"), 1).alias("new_index"))


@_query
def list_reindex(s: SparkSession, d: str) -> DataFrame:
    rows = _view(s, d, "conversations", where(h["conversations.role"], "!=", "system")).dataframe(ordered=False)
    return lists.reindexed(rows, "conv_id", ["turn"], "new_index").select("conv_id", "turn", "new_index")


@_query
def chk_unique_global(s: SparkSession, d: str) -> DataFrame:
    return constraints.duplicates(read_table(s, d, "customer"), ["c_nationkey"])


@_query
def chk_unique_scoped(s: SparkSession, d: str) -> DataFrame:
    return constraints.duplicates(BOUND.frame(s, d, "orders"), ["o_orderpriority"], scope="o_custkey")


@_query
def chk_check_predicate(s: SparkSession, d: str) -> DataFrame:
    return constraints.failing(BOUND.frame(s, d, "customer"), "c_acctbal", F.col("c_acctbal").between(0, 10000)).select(F.col("item_id").alias("c_custkey"))


@_query
def chk_lineitem_key(s: SparkSession, d: str) -> DataFrame:
    return constraints.duplicates(read_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query
def comp_chain(s: SparkSession, d: str) -> DataFrame:
    return constraints.with_computed(read_table(s, d, "lineitem"), {"net": "l_extendedprice * (1 - l_discount)", "gross": "net * (1 + l_tax)"}).select("l_orderkey", "l_linenumber", "net", "gross")


def _log(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("item"), F.col("event_type").alias("col"), F.col("value").alias("newv"))
    return changelog.with_old_values(rows)


@_query
def chg_merge(s: SparkSession, d: str) -> DataFrame:
    return changelog.merged(_log(s, d)).drop("first_old")


@_query
def chg_invert(s: SparkSession, d: str) -> DataFrame:
    return changelog.inverted(_log(s, d))


@_query
def chg_replay_state(s: SparkSession, d: str) -> DataFrame:
    return changelog.replayed(_log(s, d))


def _parts(s: SparkSession, d: str, e: Expr) -> DataFrame:
    return _view(s, d, "part", e).select(F.col("item_id").alias("p_partkey"))


@_query
def set_intersect_equiv(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d, all_of(where(_size, ">", 10), where(_price, ">", 950.0)))


@_query
def set_union_equiv(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d, any_of(where(_size, "<", 5), where(_price, "<", 950.0)))


@_query
def set_except_equiv(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d, negate(where(_size, "<", 25)))


@_query
def agg_by_list_group_top(s: SparkSession, d: str) -> DataFrame:
    rows = _view(s, d, "conversations")
    role = h["conversations.role"]
    return rows.aggregates(("count",), ("max", h["conversations.turn"]), group_by=role).dataframe("n", "m", "role")
