import random
from itertools import combinations

import numpy as np
import pytest

from skein.llm import jaccard as J
from skein.llm.components import connected_components
from skein.llm.texthash import shingle_sets, word_hashes


def roots(n, links):
    p = list(range(n))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return [f(i) for i in range(n)]


def brute(rows, words=5, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().replace(b"\x0b", b" ").split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = roots(len(rows), links)
    least = {}
    for i, r in enumerate(of):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((str(d), len(s), str(least.get(r) if sets[i] else d)) for i, ((d, _), s, r) in enumerate(zip(rows, sets, of, strict=True)))


def texts(rng, n, base_words, edits):
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w[rng.randrange(3) : len(w) - rng.randrange(3)]))
    return out


@pytest.mark.parametrize("options", [{}, {"region": 3}, {"max_broadcast": 0, "region": 12}])
def test_against_brute_force(spark, monkeypatch, options):
    rng = random.Random(7)
    monkeypatch.setattr(J, "HOT", 12)  # so that frequent shingles are met
    monkeypatch.setattr(J, "LOCAL_HOT", 2)
    found = [t for k in range(8) for t in texts(rng, 12, rng.randrange(4, 80), 7)] + texts(rng, 40, 120, 9)
    passage = " ".join(f"p{i}" for i in range(30))
    found += [passage + " " + t for t in texts(rng, 15, 25, 25)]
    rows = [(1000 - i, t) for i, t in enumerate(found)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.link_classes(docs, **options).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("bits, pivots", [(64, 32), (3, 4)])
def test_regions_that_grew_together(spark, monkeypatch, bits, pivots):
    """Unlike texts, each with shingles of the next: one region, all distances near 1, and copies here and there."""
    monkeypatch.setattr(J, "PIVOTS", pivots)
    monkeypatch.setattr(J, "NAME_BITS", bits)  # with few bits, sets share names that must be replaced
    rng = random.Random(11)
    bridge = [" ".join(f"b{i}x{j}" for j in range(8)) for i in range(121)]
    body = [" ".join(f"t{i}x{rng.randrange(1000)}" for _ in range(25)) for i in range(120)]
    found = [f"{bridge[i]} {body[i]} {bridge[i + 1]}" for i in range(120)]
    for i in range(0, 120, 5):
        w = found[i].split()
        w[rng.randrange(len(w))] = "edited"
        found.append(" ".join(w))
    found += [f"common words that many unlike texts have {' '.join(f'u{i}x{j}' for j in range(4))}" for i in range(40)]
    rows = [(5000 - i, t) for i, t in enumerate(found)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.link_classes(docs, region=6).collect())
    assert got == brute(rows)


def test_everything_overlaps(spark, monkeypatch):
    """A region of one set a task, all sets with shingles in common, none or all of them links."""
    monkeypatch.setattr(J, "PIVOTS", 4)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[:12] + [f"x{i}y{rng.randrange(9)}" for _ in range(6)] + base[12 : 12 + rng.randrange(28)])) for i in range(45)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.link_classes(docs, region=1).collect())
    assert got == brute(rows)


def test_slack_codes():
    for x in [*range(3000), 114688, 10**6]:
        code = J._slack_code(x)
        assert 0 <= code < 64 and (back := int(J._slack(np.array([code]))[0])) <= x and (back >= 0.79 * x or x > 114688)


def test_odd_tables(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.link_classes(odd).collect()) == brute(rows)
    assert J.link_classes(nothing).collect() == []
    kept = J.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11, None]))
    assert J.keep_one_of_each(nothing).collect() == []


def test_one_of_each(spark, sample):
    class_of = {r.doc_id: r.component_id for r in J.link_classes(sample).collect()}
    for limit in (J.MAX_BROADCAST, 0):
        kept = [r.doc_id for r in J.keep_one_of_each(sample, max_broadcast=limit).collect()]
        assert sorted(kept) == sorted(set(class_of.values()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(60)] + [(600, 600 + i) for i in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots(700, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}


def test_word_hashes():
    import re

    rng = random.Random(2)
    some = [bytes(rng.choice(b"ab A\t\n\x0b\x0c\r\xc3\xa9") for _ in range(rng.randrange(30))) for _ in range(200)] + [b"x" * 70_000 + b" y"]
    h, begins = word_hashes(some)
    want = [w for t in some for w in re.findall(rb"[^\x20\x09-\x0d]+", t.lower())]
    assert len(h) == len(want) and len(set(zip(h.tolist(), want, strict=True))) == len(set(want)) == len(set(h.tolist()))
    assert [len(s) for s in shingle_sets([b"a b", b"", b"a b c d e f"])] == [1, 0, 2] and begins[-1] == len(want)


def test_long_near_copies_are_not_copied_for_each_shingle(spark, monkeypatch):
    """A group of edited copies, most too far from each other to link: hundreds of shingles, each shared by other members."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        w = list(base)
        for j in rng.sample(range(400), rng.randrange(5, 12)):
            w[j] = f"e{i}x{j}"
        rows.append((i, " ".join(w)))
    read, inner = [], J.links_within

    def counted(sets, *args):
        read.append(sets.selectExpr("sum(octet_length(tokens)) as n").first().n or 0)
        return inner(sets, *args)

    monkeypatch.setattr(J, "links_within", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.link_classes(docs, region=12).collect())
    assert got == brute(rows)
    assert 0 < sum(read) < 12 * 8 * sum(n for _, n, _ in got)


def test_trimmed_keeps_what_links(spark):
    """Sets most of whose shingles no set of a fitting size has can't link."""
    sets = [range(100), range(10, 110), range(1000, 1100), [*range(1000, 1050), *range(2000, 2050)], range(5000, 5010), range(5000, 5900)]
    rows = [(i, np.array(s, dtype=np.uint64).tobytes()) for i, s in enumerate(sets)]
    left = J.trimmed(spark.createDataFrame(rows, "node bigint, tokens binary"), 75).collect()
    assert sorted(r.node for r in left) == [0, 1]
