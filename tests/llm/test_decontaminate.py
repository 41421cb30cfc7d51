import random

import pytest

from skein.llm import decontaminate as D


def edits(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, x in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


@pytest.mark.parametrize("held", [D.MAX_HITS, 40])
def test_nothing_within_the_budget_is_lost(monkeypatch, held):
    monkeypatch.setattr(D, "MAX_HITS", held)  # however few shared q-grams may be held
    rng = random.Random(3)
    hits = 0
    for _ in range(250):
        raw = "".join(rng.choice("ab cdeé") for _ in range(rng.randrange(2, 100)))
        p = D.normalized(raw)
        if not p:
            continue
        index = D.Passages.build([(0, raw)])
        s = list(p)
        for _ in range(rng.randrange(12)):
            j = rng.randrange(len(s)) if s else 0
            k = rng.randrange(3)
            s[j : j + (k < 2 and bool(s))] = ["x"] if k == 0 else [] if k == 1 else ["y"]
        noise = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(60)))
        t = D.normalized(noise() + "".join(s) + noise())
        e = edits(p, t)
        got = index.search(["other", t, ""])
        assert got[0] in ({}, got[0]) and got[2] == {}
        if e <= int(index.budget[0]):
            hits += 1
            assert got[1][0][0] == e
        else:
            assert got[1] == {}
    assert hits > 60


def test_rows(spark, odd, nothing, sample):
    items = spark.createDataFrame([(1, "quick  BROWN fox jumps over the lazy cat"), (2, None), (3, " "), (4, "fox"), (5, "not there at all, nowhere"), (4, "fox")], "item_id bigint, text string")
    for limit in (D.MAX_CHARS, 20):
        got = {(r.doc_id, r.text): [(x["item_id"], x["edits"]) for x in r.leaks] for r in D.find_leaks(odd, items, max_chars=limit).collect()}
        assert len(got) == len(set((r.doc_id, r.text) for r in odd.collect()))
        for (d, t), leaks in got.items():
            assert leaks == ([(1, 3), (4, 0)] if d in (1, 2) else [])
    assert D.find_leaks(nothing, items).collect() == []
    assert D.find_leaks(sample, items.limit(0)).where("size(leaks) > 0").count() == 0


def test_frequent_qgrams(monkeypatch):
    """Texts and passages of one repeated q-gram share the square of their length."""
    items = [(i, "ab" * (30 + i)) for i in range(6)] + [(9, "a" * 300)]
    texts = [D.normalized(t) for t in ("ab" * 400, "a" * 500 + "ab" * 33, "zz " + "ab" * 31 + " zz", "none")]
    want = D.Passages.build(items).search(texts)
    for held in (100, 1000):
        monkeypatch.setattr(D, "MAX_HITS", held)
        assert D.Passages.build(items).search(texts) == want
    assert len(want[0]) == 6 and want[3] == {} and 6 in want[1]


@pytest.mark.parametrize("limits", [{}, {"max_chars": 20}, {"max_chars": 20, "max_broadcast": 0}])
def test_ids_of_other_types(spark, limits):
    docs = spark.createDataFrame([("a", "the quick brown fox and a lazy dog", 1), (None, "lazy dog in the quick brown fox", 2), ("b", None, 3)], "doc_id string, text string, leaks int")
    items = spark.createDataFrame([("x2", "quick brown fox"), ("x1", "lazy dog"), (None, "lazy dog")], "item_id string, text string")
    got = {r.doc_id: [(x["item_id"], x["edits"]) for x in r.found] for r in D.find_leaks(docs, items, name="found", **limits).collect()}
    every = {("x1", 0), ("x2", 0), (None, 0)}
    assert {k: set(v) for k, v in got.items()} == {"a": every, None: every, "b": set()}
    assert D.find_leaks(docs, items, name="found").columns == ["doc_id", "text", "leaks", "found"]


def test_exact_passages(spark):
    d = "/root/testdata/sf0.01"
    items = [(r.item_id, D.normalized(r.text)) for r in spark.read.parquet(d + "/benchmark.parquet").collect()]
    texts = {r.doc_id: D.normalized(r.text) for r in spark.read.parquet(d + "/documents.parquet").collect()}
    want = {k: sorted(i for i, p in items if p in t) for k, t in texts.items()}
    got = {r.doc_id: r.item_ids for r in D.op8_decontaminate(spark, d).collect()}
    assert all(set(want[k]) <= set(v) for k, v in got.items())
    for k, v in got.items():
        for i in set(v) - set(want[k]):
            p = dict(items)[i]
            assert edits(p, texts[k]) <= 0.1 * len(p)
