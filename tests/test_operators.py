import random

import pytest
from pyspark.sql import functions as F

from skein.errors import ConstraintError, QueryError
from skein.operators import changelog, constraints, intervals, lists, neighbors, relations, rollups
from skein.operators.numbering import numbered
from skein.schema import SchemaBuilder
from skein.streaming.log import LiveRollup, follow, latest_values
from skein.types import Index, ValueType


def test_as_of_both_ways(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), rng.randrange(20)) for i in range(60)] + [(100, None, 1), (101, 1, None)]
    probes = [(i, rng.randrange(5), rng.randrange(20)) for i in range(30, 90)]
    r = spark.createDataFrame(rows, "item_id bigint, g bigint, o bigint")
    p = spark.createDataFrame(probes, "item_id bigint, g bigint, o bigint")
    for forward in (False, True):
        got = {(x.item_id, x.g, x.o): x.neighbour_id for x in neighbors.as_of(p, r, ["g"], ["o"], forward=forward).collect()}
        for i, g, o in probes:
            near = [(x, j) for j, k, x in rows if k == g and x is not None and ((x, j) > (o, i) if forward else (x, j) < (o, i))]
            assert got[i, g, o] == ((min if forward else max)(near)[1] if near else None)


@pytest.mark.parametrize("width", [None, 1, 7, 100])
def test_overlap_pairs(spark, width):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), s := rng.randrange(-30, 60), s + rng.randrange(0, 25)) for i in range(80)] + [(99, 0, None, 5)]
    got = intervals.overlap_pairs(spark.createDataFrame(rows, "item_id bigint, g bigint, s bigint, e bigint"), "s", "e", ["g"], width=width).collect()
    ok = [r for r in rows if r[2] is not None and r[2] < r[3]]
    want = sorted((a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    assert sorted((r.a_id, r.b_id) for r in got) == want


def test_hierarchies(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (10, 11), (11, 12), (12, 10), (20, 99)], "id bigint, parent bigint")
    assert {r.id: r.depth for r in relations.descendants(edges, [1]).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert [(r.id, r.depth) for r in relations.ancestors(edges, 5).orderBy("depth").collect()] == [(5, 0), (4, 1), (2, 2), (1, 3)]
    for bad in (10, 20):
        with pytest.raises(ConstraintError):
            relations.ancestors(edges, bad)
    assert sorted(r.id for r in relations.cyclic(edges).collect()) == [10, 11, 12]
    kids = relations.children_of(edges, "parent", [1, 1, None])
    assert sorted(r.id for r in kids.collect()) == [1, 2, 3]


def test_numbering_over_partitions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r.id for r in numbered(df, F.col("k").asc()).orderBy("pos").collect()]
    assert got == [r.id for r in df.orderBy("k").collect()]
    assert [r.pos for r in numbered(spark.range(3), F.col("id").desc(), start=5).orderBy("id").collect()] == [7, 6, 5]


def test_violations(spark):
    b = SchemaBuilder()
    up = b.create_table("Up")
    t = b.create_table("T")
    a = t.add_variant("A")
    t.add_variant("B")
    t.add_column("n", ValueType.INT64, nullable=False, check=lambda v: v > 0, check_sql="n > 0")
    t.add_column("u", ValueType.STRING, index=Index.UNIQUE)
    t.add_variant_column(a, "only_a", ValueType.INT64)
    t.add_association("up", up.handle)
    info = b.freeze().info(t.handle)
    rows = [(1, "A", None, 1, "x", 5, 1), (2, "B", None, None, "x", None, 1), (3, "C", None, 0, "x", None, 7), (4, "B", None, 2, "y", 6, None), (5, "B", None, 2, "y", None, None)]
    found = constraints.violations(spark.createDataFrame(rows, info.struct), info, {"up": spark.createDataFrame([(1,)], "item_id bigint")}).collect()
    assert sorted((r.rule, r.column, r.item_id or 0) for r in found) == [("check", "n", 3), ("null", "n", 2), ("reference", "up", 3), ("unique", "u", 0), ("variant", "variant", 3), ("variant column", "only_a", 4)]


def test_lists(spark):
    order = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "g bigint, i bigint")
    got = {r.i: r.new for r in lists.rotate(order, "g", "i", 0, 5, 2, "new").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [2, 3, 4, 0, 1]
    with pytest.raises(QueryError):
        lists.rotate(order, "g", "i", -1, 2, 0)
    assert lists.order_violations(spark.createDataFrame([(1, 0), (1, 2), (2, 0), (2, 1)], "g bigint, i bigint"), "g", "i").first().g == 1


def test_ordered_replay(spark):
    rng = random.Random(4)
    state = {g: list(range(g * 100, g * 100 + 6)) for g in range(4)}
    rows = [(g, x, i) for g, xs in state.items() for i, x in enumerate(xs)]
    log, fresh = [], 1000
    for seq in range(200):
        g = rng.randrange(5)
        xs = state.setdefault(g, [])
        op = rng.choice(["insert", "remove", "rotate"]) if xs else "insert"
        if op == "insert":
            at = rng.randrange(len(xs) + 1)
            log.append((seq, g, op, fresh, at, None, None))
            xs.insert(at, fresh)
            fresh += 1
        elif op == "remove":
            at = rng.randrange(len(xs))
            log.append((seq, g, op, xs[at], at, None, None))
            del xs[at]
        else:
            start = rng.randrange(len(xs))
            n = rng.randrange(len(xs) - start + 1)
            off = rng.randrange(-7, 8)
            log.append((seq, g, op, None, start, n, off))
            lists.apply_list_op(xs, "rotate", at=start, count=n, offset=off)
    out = lists.replay(spark.createDataFrame(rows, "grp bigint, item bigint, list_index bigint"), spark.createDataFrame(log, "seq bigint, grp bigint, op string, item bigint, at bigint, cnt bigint, off bigint"))
    got = {}
    for r in out.orderBy("grp", "list_index").collect():
        got.setdefault(r.grp, []).append(r.item)
    assert got == {g: xs for g, xs in state.items() if xs}


def test_log_algebra(spark):
    rng = random.Random(5)
    cells, log = {}, []
    for seq in range(300):
        k = (rng.randrange(6), f"c{rng.randrange(3)}")
        log.append((seq, *k, cells.get(k), float(seq)))
        cells[k] = float(seq)
    df = spark.createDataFrame(log, "seq bigint, item bigint, col string, oldv double, newv double")
    assert {(r.item, r.col): r.value for r in changelog.replayed(df).collect()} == cells
    assert df.exceptAll(changelog.with_old_values(df.drop("oldv")).select(*df.columns)).isEmpty()
    back = changelog.inverted(df)
    undone = changelog.replayed(back.select(F.col("inv_seq").alias("seq"), "item", "col", F.col("inv_new").alias("newv")))
    assert all(r.value is None for r in undone.collect())
    m = changelog.merged(df).collect()
    assert all(r.first_old is None and r.last_new == cells[r.item, r.col] for r in m)
    state = spark.createDataFrame([(0, "c0", -1.0), (9, "c9", -2.0)], "item bigint, col string, value double")
    after = changelog.applied(state, df, removed=spark.createDataFrame([(5,)], "item bigint"))
    assert {(r.item, r.col): r.value for r in after.collect()} == {k: v for k, v in (cells | {(9, "c9"): -2.0}).items() if k[0] != 5}


def test_rollups_stand_for_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, 7.0), (2, 3.0), (None, 1.0)], "p bigint, v double")
    r = rollups.merge_rollups(rollups.rollup(df.where("v > 3"), "p", "v"), rollups.rollup(df.where("not (v > 3) or v is null"), "p", "v"))
    by = lambda kind, **o: {x.group_key: x.value for x in rollups.read_rollup(r, kind, **o).collect()}
    assert by("count") == {1: 2, 2: 2, None: 1} and by("sum", parents=[2, 2]) == {2: 10.0} and by("min") == {1: None, 2: 3.0, None: 1.0}
    assert rollups.read_rollup(r, "max", by_parent=False).first().value == 7.0


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "parent bigint, value double"
    live = LiveRollup(spark, str(tmp_path / "rollup"))
    want = {}
    for n in range(3):
        rows = [(i % 4, float(n * 10 + i)) for i in range(10)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        for p, v in rows:
            want[p] = want.get(p, 0) + v
        live.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "check")).awaitTermination()
        assert {r.parent: r.total for r in live.read().collect()} == want
    live.add(spark.createDataFrame([(i % 4, float(20 + i)) for i in range(10)], schema), 2)  # a batch that is run again counts once
    assert {r.parent: r.total for r in live.read().collect()} == want
    seen = []
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 0, "column_updated", 0, 1, "{}")], "txn bigint, seq bigint, kind string, container int, item_id bigint, operation string").write.parquet(log)
    follow(spark, log, lambda df, i: seen.append(df.count()), str(tmp_path / "check2")).awaitTermination()
    assert seen == [1]
    (tmp_path / "cells").mkdir()
    cells = spark.readStream.schema("seq bigint, item bigint, col string, newv double").parquet(str(tmp_path / "cells"))
    assert latest_values(cells).isStreaming
