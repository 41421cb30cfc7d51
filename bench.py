"""Times the benchmark shapes over one scale; prints one JSON line.

$BENCH_SF_DIR and $BENCH_CPUS choose the data and the cores. Each shape runs once to
warm up and then five times; its figure is the median. Results are counted or
aggregated by Spark, never collected as rows. ``plain_spark`` and ``duckdb`` have the
same for the shapes' SQL, run on the same files without this engine.
"""

from __future__ import annotations

import json
import os
import random
import time
from statistics import median

import duckdb
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein import oracles, queries
from skein.changes import ChangeSet, Operation
from skein.functions.predicates import FieldRef, all_of, any_of, negate, where
from skein.plans.view import QuerySpec, descending
from skein.sources.binding import Bound
from skein.types import Change

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 5


def shapes(spark: SparkSession) -> dict:
    b = Bound()
    h = b.h
    # orders: x is the key, the parent the customer; events have variants and a nullable value
    n = b.view(spark, FOLDER, "orders").count()
    x, parent, total = h["orders.o_orderkey"], h["orders.o_custkey"], h["orders.o_totalprice"]
    q = lambda e, *sort: b.view(spark, FOLDER, "orders", QuerySpec(e, sort))
    ev = lambda e: b.view(spark, FOLDER, "events", QuerySpec(e))
    everything = all_of()
    selective = all_of(where(x, ">", n - 100), where(total, "<", 400000.0))
    two = any_of(where(parent, "=", 3), where(parent, "=", 4))
    done = lambda a: a.dataframe().write.format("noop").mode("overwrite").save()
    out = {
        "id_equal": lambda: q(where(FieldRef.id(), "=", n // 2)).count(),
        "parent_equal": lambda: q(where(parent, "=", 3)).count(),
        "numeric_greater": lambda: q(where(x, ">", n - 10)).count(),
        "numeric_and_selective": lambda: q(selective).count(),
        "numeric_or": lambda: q(any_of(where(x, "<", 10), where(total, "<", 1100.0))).count(),
        "negated_range": lambda: q(negate(where(x, "<", n - 10))).count(),
        "string_equal": lambda: q(where(h["orders.o_orderpriority"], "=", "1-URGENT")).count(),
        "variant_equal": lambda: ev(where(FieldRef.variant(h["events.purchase"]), "=", "purchase")).count(),
        "bool_not_equal": lambda: b.view(spark, FOLDER, "customer", QuerySpec(where(h["customer.c_in_debt"], "!=", False))).count(),
        "binary_equal": lambda: b.view(spark, FOLDER, "customer", QuerySpec(where(h["customer.c_tag"], "=", b"BUILDING"))).count(),
        "null_equal": lambda: ev(where(h["events.v"], "=", None)).count(),
        "limit_one": lambda: q(where(x, ">", n - 10)).limit(1).count(),
        "sort_limit_one": lambda: q(everything, descending(x)).limit(1).to_rows(),
        "aggregate_count": lambda: done(q(everything).aggregate("count")),
        "aggregate_sum": lambda: done(q(everything).aggregate("sum", x)),
        "aggregate_max": lambda: done(q(everything).aggregate("max", total)),
        "count_by_parent": lambda: done(q(everything).aggregate("count", group_by=parent)),
        "parents_then_count": lambda: done(q(two).aggregate("count", group_by=parent)),
        "sum_by_parent": lambda: done(q(everything).aggregate("sum", x, parent)),
        "parents_then_sum": lambda: done(q(two).aggregate("sum", x, parent)),
        "max_by_parent": lambda: done(q(everything).aggregate("max", total, parent)),
    }
    for name in ("flagship", "rel_join_parent", "nbr_prev_next", "ivl_pairs", "chg_merge", "list_reindex", "chk_lineitem_key", "comp_chain"):
        out[name] = lambda name=name: queries.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    rng = random.Random(0xD1A1)
    ops = [Operation(Change.COLUMN_UPDATED, 0, rng.randrange(4), column=f"value-{rng.randrange(4)}", old=0, new=1_000_000 + i) for i in range(1000)]
    for size in (1, 10, 100, 1000):
        sets = [ChangeSet(ops[i : i + size]) for i in range(0, 1000, size)]
        out[f"change_set_merge_{size}"] = lambda sets=sets: ChangeSet.merge(sets)
    return out


def plain(n: int) -> dict[str, str]:
    """SQL of the shapes; n orders."""
    purchases = "case when event_type = 'purchase' then value end"
    return {
        "id_equal": f"select count(*) from orders where o_orderkey = {n // 2}",
        "parent_equal": "select count(*) from orders where o_custkey = 3",
        "numeric_greater": f"select count(*) from orders where o_orderkey > {n - 10}",
        "numeric_and_selective": f"select count(*) from orders where o_orderkey > {n - 100} and o_totalprice < 400000",
        "numeric_or": "select count(*) from orders where o_orderkey < 10 or o_totalprice < 1100",
        "negated_range": f"select count(*) from orders where not (o_orderkey < {n - 10})",
        "string_equal": "select count(*) from orders where o_orderpriority = '1-URGENT'",
        "bool_not_equal": "select count(*) from customer where (c_acctbal < 0) <> false",
        "variant_equal": "select count(*) from events where event_type = 'purchase'",
        "null_equal": f"select count(*) from events where ({purchases}) is null",
        "limit_one": f"select count(*) from (select o_orderkey from orders where o_orderkey > {n - 10} limit 1) z",
        "sort_limit_one": "select * from orders order by o_orderkey desc limit 1",
        "aggregate_count": "select count(*) from orders",
        "aggregate_sum": "select sum(o_orderkey) from orders",
        "aggregate_max": "select max(o_totalprice) from orders",
        "count_by_parent": "select o_custkey, count(*) as n from orders group by o_custkey",
        "parents_then_count": "select o_custkey, count(*) as n from orders where o_custkey = 3 or o_custkey = 4 group by o_custkey",
        "sum_by_parent": "select o_custkey, sum(o_orderkey) as s from orders group by o_custkey",
        "parents_then_sum": "select o_custkey, sum(o_orderkey) as s from orders where o_custkey = 3 or o_custkey = 4 group by o_custkey",
        "max_by_parent": "select o_custkey, max(o_totalprice) as m from orders group by o_custkey",
    } | {k: oracles.SQL[k] for k in ("flagship", "rel_join_parent", "nbr_prev_next", "ivl_pairs", "list_reindex", "chk_lineitem_key", "comp_chain")}


def timed(run) -> float:
    run()
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(median(took), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: timed(run) for name, run in shapes(spark).items()}
    duck = duckdb.connect()
    duck.execute(f"set threads={CPUS}")
    for name in ("orders", "events", "customer", "nation", "conversations", "lineitem"):
        path = f"{FOLDER}/{name}.parquet"
        spark.read.parquet(path).createOrReplaceTempView(name)
        duck.execute(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    n = spark.table("orders").count()
    noop = lambda sql: spark.sql(sql).write.format("noop").mode("overwrite").save()
    plain_spark = {name: timed(lambda sql=sql: noop(sql)) for name, sql in plain(n).items()}
    in_duckdb = {name: timed(lambda sql=sql: duck.execute(sql).fetchnumpy()) for name, sql in plain(n).items()}
    rows = spark.table("lineitem").agg(F.count(F.lit(1))).first()[0]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "plain_spark": plain_spark, "duckdb": in_duckdb, "sf": os.path.basename(FOLDER.rstrip("/")), "lineitem_rows": rows, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
