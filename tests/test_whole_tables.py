"""Queries that once read or returned a part of their table: every row, against brute force."""

import math

import duckdb

from skein import queries

DATA = "/root/testdata/sf0.01"


def table(name, columns):
    return duckdb.sql(f"select {columns} from '{DATA}/{name}.parquet'").fetchall()


def test_ivl_pairs_of_every_user(spark):
    by_user = {}
    for i, u, v in table("events", "event_id, user_id, value"):
        if u is not None and v is not None:
            by_user.setdefault(u, []).append((i, math.floor(v)))
    want = sorted((i, j) for rows in by_user.values() for i, s in rows for j, t in rows if i < j and abs(s - t) < 20)
    got = sorted((r.a_id, r.b_id) for r in queries.QUERIES["ivl_pairs"](spark, DATA).collect())
    assert max(by_user) >= 10 and got == want


def test_nbr_probe_prev_of_every_order(spark):
    by_customer = {}
    for o, c in table("orders", "o_orderkey, o_custkey"):
        by_customer.setdefault(c, []).append(o)
    want = {o: max((p for p in os if p < o), default=None) if c is not None else None for c, os in by_customer.items() for o in os}
    got = queries.QUERIES["nbr_probe_prev"](spark, DATA).collect()
    assert len(got) == len(want) > 200 and {r.o_orderkey: r.prev_id for r in got} == want


def test_sort_nulls_lowest_of_every_event(spark):
    rows = table("events", "event_id, case when event_type = 'purchase' then value end")
    want = [i for i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    got = sorted(queries.QUERIES["sort_nulls_lowest"](spark, DATA).collect(), key=lambda r: r.rn)
    assert [(r.event_id, r.rn) for r in got] == [(i, n) for n, i in enumerate(want, 1)]


def test_comp_chain_of_every_line(spark):
    rows = table("lineitem", "l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax")
    want = sorted((o, n, net := p * (1 - d), net * (1 + t)) for o, n, p, d, t in rows)
    got = sorted((r.l_orderkey, r.l_linenumber, r.net, r.gross) for r in queries.QUERIES["comp_chain"](spark, DATA).collect())
    assert got == want
