import numpy as np
from pyspark.sql import functions as F

from skein.llm import langid
from skein.llm import langid as L


def random_network(rng, langs=3):
    total = len(L.WIDTHS) * L.FILTERS
    p = {"embed": rng.normal(0, 0.5, (256, L.EMBED)), "bias": rng.normal(0, 0.1, total), "dense": rng.normal(0, 0.3, (total, langs)), "dense_bias": rng.normal(0, 0.1, langs)}
    return p | {f"w{k}": rng.normal(0, 0.3, (w * L.EMBED, L.FILTERS)) for k, w in enumerate(L.WIDTHS)}


def test_folded_tables_are_the_convolution():
    rng = np.random.default_rng(1)
    p = random_network(rng)
    net = L.Network(["a", "b", "c"], p["embed"], [p[f"w{k}"] for k in range(len(L.WIDTHS))], p["bias"], p["dense"], p["dense_bias"])
    x = rng.integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    places = L.WINDOW - max(L.WIDTHS) + 1
    want = np.array([[max(np.concatenate([p["embed"][row[i + j]] for j in range(w)]) @ p[f"w{k}"][:, f] for i in range(places)) for k, w in enumerate(L.WIDTHS) for f in range(L.FILTERS)] for row in x])
    assert np.allclose(L._responses(x, net.tables()), want, atol=1e-4)


def test_gradients_are_differences():
    rng = np.random.default_rng(2)
    p = random_network(rng)
    x, y, weight = rng.integers(0, 256, (6, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 1]), np.array([1.0, 0.5, 2.0])
    loss, g = L.gradients(p, x, y, weight)
    assert loss > 0
    for name, a in p.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in a.shape)
            if name == "embed":
                at = (int(x[rng.integers(6), rng.integers(L.WINDOW)]), at[1])
            ends = []
            for step in (1e-6, -1e-6):
                a[at] += step
                ends.append(L.gradients(p, x, y, weight)[0])
                a[at] -= step
            assert np.isclose((ends[0] - ends[1]) / 2e-6, g[name][at], rtol=1e-4, atol=1e-6), name


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op3_language_id(spark, "/root/testdata/sf0.01")
    right = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_odd_texts(spark, odd, sample):
    out = langid.identify(odd, sample, keep=("doc_id", "text")).collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) or r.lang_pred in {"en", "de", "fr", "es"}
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_nothing_to_learn_or_predict(odd, nothing, sample):
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(nothing, sample).collect() == []


def test_windows_cover_texts():
    import numpy as np

    for n in (0, 1, 253, 256, 257, 509, 510, 2000):
        t = np.arange(n) % 251
        x, owner, held = langid.windows_of([t.astype(np.uint8), t.astype(np.uint8)])
        seen = np.concatenate([w[: langid.STRIDE] if i < len(x) // 2 - 1 else w for i, w in enumerate(x[: len(x) // 2])])
        assert (seen[:n] == t).all() and set(owner) == {0, 1}


def test_every_language_is_learned(spark):
    rows = [(n * 100 + i, f"text {i} of language {n}", f"l{n:02}") for n in range(80) for i in range(1 + n % 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for total, most in ((langid.TRAIN_TOTAL, len(rows)), (80, 240)):
        x, y, langs = langid.training_windows(docs, each=1, total=total)
        assert langs == [f"l{n:02}" for n in range(80)]
        assert set(y) == set(range(80)) and len(x) == len(y) <= most
