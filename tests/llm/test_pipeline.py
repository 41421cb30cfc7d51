import hashlib
import random

import numpy as np
import test_jaccard
import test_lines
import test_quality
import test_tokens

import corpus_pipeline as C
from skein.llm import decontaminate, jaccard, lines, quality
from skein.llm.common import persisted


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.01"
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(d + "/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in C.STAGES:
        docs = persisted(stage(spark, docs, d))
        steps[name] = docs
        assert name == "byte_bpe" or docs.columns == columns
    labels = spark.read.parquet(d + "/labels.parquet")
    start = spark.read.parquet(d + "/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(steps["quality_rules"]) == ids(quality.judge(start, labels).where("kept"))
    assert ids(steps["line_dedup"]) == ids(steps["quality_rules"])
    assert lines.frequent_lines(steps["line_dedup"], 10).count() == 0
    assert all(r.n_chars == len(r.text) for r in steps["line_dedup"].collect())
    classes = jaccard.link_classes(steps["near_duplicates"])
    assert classes.where("doc_id <> component_id").count() == 0
    assert ids(steps["near_duplicates"]) == sorted({r.component_id for r in jaccard.link_classes(steps["line_dedup"]).collect()})
    left = decontaminate.find_leaks(steps["near_duplicates"], spark.read.parquet(d + "/benchmark.parquet")).where("size(leaks) = 0")
    assert ids(steps["decontamination"]) == ids(left)
    text = {r.doc_id: r.text for r in steps["decontamination"].collect()}
    out = steps["byte_bpe"].collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in text.items()}
    assert sorted((r.doc_id, r.ids_sha256) for r in C.run(spark, d).collect()) == sorted((r.doc_id, r.ids_sha256) for r in out)


def least_edits(p, t):
    """Of a passage and any part of a text."""
    t = np.array([ord(c) for c in t])
    k = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, dtype=np.int64)
    for c in p:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (t != ord(c)))
        row = k + np.minimum.accumulate(new - k)
    return int(row.min())


def test_against_brute_force(spark):
    """The whole pipeline by plain Python: rules, lines, links, edits and the library's ids."""
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text, r.lang or "und") for r in spark.read.parquet(d + "/documents.parquet").collect()}
    said = {r.doc_id: r.quality for r in spark.read.parquet(d + "/labels.parquet").collect()}
    cutoff = test_quality.cutoffs_by_hand(docs, said)
    left = {i: t for i, (t, lang) in docs.items() if not test_quality.expected(t)[5] and test_quality.rung_by_hand(t) > cutoff.get(lang, 0)}
    left = {i: t for i, _, _, t in test_lines.brute(list(left.items()), 10)}
    rows = sorted(left.items())
    left = {i: left[i] for (i, _), (_, _, root) in zip(sorted(rows, key=lambda r: str(r[0])), sorted(test_jaccard.brute(rows)), strict=True) if str(i) == root or root == "None"}
    passages = [p for r in spark.read.parquet(d + "/benchmark.parquet").collect() if (p := decontaminate.normalized(r.text))]
    budget = lambda p: max(0, min(int(decontaminate.EDIT_RATE * len(p)), (len(p) - decontaminate.Q) // decontaminate.Q))
    shingles = [({p[i : i + 8] for i in range(len(p) - 7)}, p) for p in passages]
    near = lambda t: any(sum(g in t for g in grams) * 8 >= len(grams) and least_edits(p, t) <= budget(p) for grams, p in shingles)  # noqa: E731  a passage within the budget leaves far more of its grams
    left = {i: t for i, t in left.items() if not near(decontaminate.normalized(t))}
    lib = test_tokens.library()
    want = {i: hashlib.sha256(np.array(lib.encode_ordinary(t), dtype="<u4").tobytes()).hexdigest() for i, t in left.items()}
    assert {r.doc_id: r.ids_sha256 for r in C.run(spark, d).collect()} == want and len(want) > 50


def test_odd_and_empty_tables(spark, odd, nothing):
    d = "/root/testdata/sf0.001"
    for docs in (odd, nothing):
        for name, stage in C.STAGES:
            out = persisted(stage(spark, docs, d))
            if name != "byte_bpe":
                assert out.columns == docs.columns and out.schema["n_words"].dataType.simpleString() == "string"
                assert not out.where("n_words <> 'w' or kept <> 'k' or leaks <> 1 or n_lines <> 4").count()
            assert out.count() <= docs.count()
    left = {r.doc_id for r in C.near_duplicates(spark, odd, d).collect()}
    assert {3, 4, 5, None} <= left and len({1, 2} & left) == 1  # texts without words stay


def test_a_large_group_of_copies(spark, tmp_path):
    """A group of thousands of near copies of one text, which share their lines, words and windows, goes through all stages."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(3, 9)))
    base = [word() for _ in range(220)]
    texts = []
    for _ in range(2500):
        w = list(base)
        for _ in range(rng.randrange(1, 3)):  # no two are equal, or their one long line would go
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w) + "\nthe same line everywhere")
    texts += [" ".join(word() for _ in range(60)) for _ in range(300)]
    rows = [(i, t, "en", "hot", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(0, 2800, 3)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[-1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = sorted(r.doc_id for r in C.run(spark, str(tmp_path)).collect())
    assert out == [0, *range(2500, 2799)]
