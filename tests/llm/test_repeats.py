import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from skein.llm import repeats as R


def brute(texts, n):
    c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if c[t[i : i + n]] > 1:
                covered[i : i + n] = b"\1" * n
        out.append(bytes(b for b, x in zip(t, covered, strict=True) if not x))
    return out


def brute_words(rows, n):
    """Words that shared strings of n words cover, in documents that share one with another document."""
    split = [re.findall(rb"[^\x20\x09-\x0d]+", t.lower()) for _, t in rows]
    places = defaultdict(list)
    for k, w in enumerate(split):
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append((k, i))
    covered, shares = [set() for _ in rows], set()
    for found in places.values():
        if len(found) > 1:
            docs = {rows[k] for k, _ in found}
            for k, i in found:
                covered[k] |= set(range(i, i + n))
                if len(docs) > 1:
                    shares.add(k)
    return [len(c) if k in shares else 0 for k, c in enumerate(covered)]


@pytest.mark.parametrize("piece", [1 << 19, 64])
@pytest.mark.parametrize("options", [{}, {"bucket_limit": 3}])
def test_against_brute_force(spark, options, piece, monkeypatch):
    rng = random.Random(len(options))
    if piece == 64:
        monkeypatch.setattr(R, "PIECE", piece)
    base = ["".join(rng.choice("ab") if k % 3 == 0 else rng.choice("abcdefgh é") for _ in range(rng.randrange(10, 300))) for k in range(30)]
    texts = ["".join(rng.choice(base)[rng.randrange(5) :][: rng.randrange(5, 300)] for _ in range(rng.randrange(5))) for _ in range(90)]
    texts += ["a" * 200, "a" * 60, "", "ab" * 100, texts[5], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in R.remove_repeats(docs, length=40, q=10, words=7, **options).collect()}
    shared = brute_words([(i, (t or "").encode()) for i, t in enumerate(texts)], 7)
    assert {i: r.n_shared_words for i, r in got.items()} == dict(enumerate(shared)) and any(shared)
    want = brute([(t or "").encode() for t in texts], 40)
    for i, w in enumerate(want):
        r = got[i]
        assert bytes(r.left) == w and r.n_removed == r.n_bytes - len(w) == sum(s["end"] - s["start"] for s in r.spans) and r.n_spans == len(r.spans)


@pytest.mark.parametrize("unit", [R.Bytes, R.Words])
def test_long_texts_in_pieces(monkeypatch, unit):
    """Whatever the pieces, every start is in one segment, whose string's least q-gram is its anchor."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 3, 700, 50, 300)]
    data, begin = unit.symbols(texts)
    for piece in (R.PIECE, 1, 17, 100):
        monkeypatch.setattr(R, "PIECE", piece)
        got = R.segments_of(texts, 20, 5, unit)
        starts = sorted((t, i) for t, a, z in zip(got["text"], got["start"], got["stop"], strict=True) for i in range(a, z))
        assert starts == [(t, i) for t in range(len(texts)) for i in range(begin[t + 1] - begin[t] - 19)]
        strings = {}
        for t, a, z, anchor in zip(got["text"], got["start"], got["stop"], got["anchor"], strict=True):
            for i in range(a, z):
                assert a <= i <= anchor <= i + 15
                strings.setdefault(data[begin[t] + i : begin[t] + i + 20].tobytes(), set()).add((data[begin[t] + anchor : begin[t] + anchor + 5].tobytes(), anchor - i))
        assert all(len(v) == 1 for v in strings.values())


def test_a_passage_within_one_document(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{passage} and {passage}"), (2, f"some {passage}"), (3, "x " + " ".join(f"v{i}" for i in range(55)) + " y " + " ".join(f"v{i}" for i in range(55))), (4, "short")]
    got = {r.doc_id: r.n_shared_words for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 120, 2: 60, 3: 0, 4: 0}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(d + "/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text.encode() for r in rows], 400), strict=True))
    got = R.op7_repeated_spans(spark, d).collect()
    assert {r.doc_id: r.n_bytes - r.n_removed for r in got} == {k: len(v) for k, v in want.items()} and sum(r.n_removed for r in got) > 0


def test_odd_tables(odd, nothing):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.select("doc_id", "text").collect()]
    want = sorted((str(d), len(w)) for (d, _), w in zip(rows, brute([t for _, t in rows], 10), strict=True))
    assert sorted((str(r.doc_id), len(r.left)) for r in R.remove_repeats(odd, length=10, q=5).collect()) == want
    assert R.remove_repeats(nothing).collect() == []


def test_nothing_is_left_but_what_the_result_reads(spark):
    """Scratch tables go with the last step that reads them, shuffle files with the step that wrote them; bucket limits of 3 take the longest way."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for f in blocks.getAllFiles().mkString("\n").split("\n") if (n := f.rsplit("/", 1)[-1]).startswith("shuffle_")}
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    folders = lambda: set(Path(root.removeprefix("file:")).glob("skein-*"))
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(100)) for _ in range(5)]
    rows = [(i, " ".join(rng.choice(base)[: rng.randrange(20, 100)] for _ in range(9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scratch, files, before = folders(), shuffled(), spark.conf.get(option, None)
    out = R.remove_repeats(docs, length=40, q=10, words=7, bucket_limit=3)
    time.sleep(2)  # Spark deletes them in the background
    assert len(folders() - scratch) == 2
    assert sorted(shuffled() - files) == []
    assert spark.conf.get(option, None) == before
    assert out.count() == out.count() == 60
