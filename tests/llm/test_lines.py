import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from skein.llm import lines, queries


def brute(rows, min_docs, keep_first=False):
    keyed = [(d, [(x, x.strip(" \t\n\x0b\x0c\r").encode().lower()) for x in (t or "").split("\n")]) for d, t in rows]
    docs, first = defaultdict(int), {}
    for d, ls in keyed:
        for k in {k for _, k in ls if k}:
            docs[k] += 1
    for d, ls in keyed:
        for i, (_, k) in enumerate(ls):
            first[k] = min(first.get(k, (d, i)), (d, i), key=lambda x: (x[0] is not None, x))
    out = []
    for d, ls in keyed:
        gone = [i for i, (_, k) in enumerate(ls) if k and docs[k] >= min_docs and not (keep_first and first[k] == (d, i))]
        out.append((d, len(ls), len(gone), "\n".join(x for i, (x, _) in enumerate(ls) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limit", [lines.MAX_BROADCAST_KEYS, 0])
def test_against_brute_force(spark, sample, keep_first, limit):
    rows = [(r.doc_id, r.text) for r in sample.collect()] + [(None if i == 0 else 9000 + i, t) for i, t in enumerate([None, "", "A \n\n b\r\na", "a\nA\na", "only", "\tB\x0b\nÉ\né", "a\nb"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = lines.drop_frequent_lines(docs, 3, keep_first=keep_first, broadcast_keys=limit).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got), key=str) == brute(rows, 3, keep_first)


def test_a_full_filter_loses_nothing():
    rng = np.random.default_rng(1)
    hi = rng.integers(-(1 << 63), 1 << 63, 4000)
    hi = np.concatenate([hi, hi[:50], hi[:20]])
    n = np.where(np.arange(len(hi)) % 97 == 0, 2, 1)
    names, count = np.unique(hi, return_counts=True)
    repeated = np.isin(hi, names[count > 1]) | (n > 1)
    for bits, share in ((1 << 23, 0.05), (1 << 6, 1.0)):
        got = lines.suspects(hi, n, bits)
        assert got[repeated].all() and got.mean() <= share


def test_ranges_give_the_same(spark, sample, monkeypatch):
    want = sorted(tuple(r) for r in lines.frequent_lines(sample, 3).collect())
    monkeypatch.setattr(lines, "RANGE_LINES", 40)
    assert want and want == sorted(tuple(r) for r in lines.frequent_lines(sample, 3).collect())


@pytest.mark.parametrize("limit", [lines.MAX_BROADCAST_KEYS, 0])
def test_ids_of_other_types(spark, limit):
    docs = spark.createDataFrame([("b", "x\ny"), ("a", "z\nX"), (None, "q"), ("c", "\n".join(["x"] * 3000))], "doc_id string, text string")
    got = {r.doc_id: r.text for r in lines.drop_frequent_lines(docs, 2, keep_first=True, broadcast_keys=limit).collect()}
    assert got == {"a": "z\nX", "b": "y", None: "q", "c": ""}


def test_odd_tables(odd, nothing):
    out = lines.drop_frequent_lines(odd, 2)
    assert set(out.columns) == set(odd.columns) | {"n_dropped"} and out.count() == odd.count()
    assert out.where("text is null").count() == 1
    assert {r.n_dropped for r in out.where("doc_id = 11").collect()} == {1}  # each repeated row is a document
    assert lines.drop_frequent_lines(nothing, 2).count() == 0


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    want = sorted(c.sql(queries.ORACLE_SQL["op5_line_dedup"]).fetchall())
    assert sorted(tuple(r) for r in lines.op5_line_dedup(spark, d).collect()) == want
