"""Language identification by a byte convolutional network.

Bytes of lower-cased UTF-8 are embedded; filters of several widths slide over a
window of fixed length, each filter's largest response goes through a rectifier
to a softmax layer. The network is trained with numpy on windows of a bounded
sample of labelled texts, and applied to all windows of every text, in batches: a
document's prediction comes from the mean of its windows' outputs, weighted by
the bytes that they hold.

For prediction, embeddings and filters are folded into tables of two-byte codes,
so that a response is a sum of two rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, table

#: Network: bytes of a window, embedding, filter widths, filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 8
#: Windows overlap so that the widest filter sees every place.
STRIDE = WINDOW - max(WIDTHS) + 1
#: Sample: labelled documents of each language and in all (about), windows of a document.
TRAIN_DOCS, TRAIN_TOTAL, TRAIN_WINDOWS = 500, 32_000, 6
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.004, 7
#: Windows that go through the network at once.
AT_ONCE = 256

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # for each width: width * EMBED x FILTERS
    bias: np.ndarray  # of all filters
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Contributions of the bytes at 0 and 1, and at 2 and 3, by two-byte code, of all filters."""
        n = len(WIDTHS) * FILTERS
        tap = np.zeros((4, 256, n), dtype=np.float32)
        for k, w in enumerate(WIDTHS):
            for j in range(w):
                tap[j, :, k * FILTERS : (k + 1) * FILTERS] = self.embed @ self.filters[k][j * EMBED : (j + 1) * EMBED]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, n)  # noqa: E731  code: first byte * 256 + second
        return pair(tap[0], tap[1]), pair(tap[2], tap[3])


def _responses(x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Largest response of each filter in each window; x: windows x WINDOW bytes."""
    code = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
    # a place is valid for all filters: those of the widest
    n = WINDOW - max(WIDTHS) + 1
    first, second = tables
    out = np.take(first, code[:, :n], axis=0)
    out += np.take(second, code[:, 2 : n + 2], axis=0)
    return out.max(axis=1)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted mean cross entropy of some windows, and its gradient, which passes the place of each filter's maximum."""
    total, places = len(WIDTHS) * FILTERS, WINDOW - max(WIDTHS) + 1
    e = p["embed"][x]
    g = {k: np.zeros_like(a) for k, a in p.items()}
    pooled = np.zeros((len(x), total), dtype=e.dtype)
    patches = []
    for k, w in enumerate(WIDTHS):
        cols = np.concatenate([e[:, j : j + places] for j in range(w)], axis=2)
        out = cols @ p[f"w{k}"]
        where = out.argmax(axis=1)
        patches.append((cols, where))
        pooled[:, k * FILTERS : (k + 1) * FILTERS] = np.take_along_axis(out, where[:, None, :], axis=1)[:, 0]
    hidden = np.maximum(pooled + p["bias"], 0)
    logits = hidden @ p["dense"] + p["dense_bias"]
    prob = np.exp(logits - logits.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    at = np.arange(len(x))
    loss = float(-(weight[y] * np.log(prob[at, y])).mean())
    d = prob
    d[at, y] -= 1
    d *= (weight[y] / len(x))[:, None]
    d = d.astype(e.dtype)
    g["dense"], g["dense_bias"] = hidden.T @ d, d.sum(axis=0)
    dh = (d @ p["dense"].T) * (hidden > 0)
    g["bias"] = dh.sum(axis=0)
    rows = at[:, None]
    for k, w in enumerate(WIDTHS):
        cols, where = patches[k]
        own = dh[:, k * FILTERS : (k + 1) * FILTERS]
        best = cols[rows, where]  # windows x FILTERS x width * EMBED
        g[f"w{k}"] = np.einsum("bfc,bf->cf", best, own)
        back = own[:, :, None] * p[f"w{k}"].T[None]
        for j in range(w):
            np.add.at(g["embed"], x[rows, where + j], back[:, :, j * EMBED : (j + 1) * EMBED])
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    n, total = len(langs), len(WIDTHS) * FILTERS
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(total), "dense": rng.normal(0, 0.3, (total, n)), "dense_bias": np.zeros(n)}
    p |= {f"w{k}": rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for k, w in enumerate(WIDTHS)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    weight = len(labels) / (n * np.maximum(np.bincount(labels, minlength=n), 1))  # languages count alike
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, g = gradients(p, windows[pick], labels[pick], weight)
            steps += 1
            rate = RATE * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return Network(langs, p["embed"], [p[f"w{k}"] for k in range(len(WIDTHS))], p["bias"], p["dense"], p["dense_bias"])


def prepared(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode(), dtype=np.uint8)


def windows_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text of each, and the share of it that is text; spaces fill up the last."""
    counts = np.array([max(1, -(-(len(t) - (WINDOW - STRIDE)) // STRIDE)) for t in texts], dtype=np.int64)
    room = counts * STRIDE + WINDOW - STRIDE
    starts = np.concatenate([[0], np.cumsum(room)])
    buffer = np.full(starts[-1], 32, dtype=np.uint8)
    for s, t in zip(starts[:-1], texts, strict=True):
        buffer[s : s + len(t)] = t
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[:-1][owner] + nth * STRIDE
    size = np.array([len(t) for t in texts], dtype=np.int64)[owner]
    held = np.clip(size - nth * STRIDE, 1, WINDOW) / WINDOW
    return np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)[at], owner, held


def predict(net: Network, tables, texts: list[str | None]) -> tuple[list[str], list[float]]:
    x, owner, held = windows_of([prepared(t) for t in texts])
    sums = np.zeros((len(texts), len(net.langs)))
    mass = np.zeros(len(texts))
    for at in range(0, len(x), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        hidden = np.maximum(_responses(x[part], tables) + net.bias, 0)
        logits = hidden @ net.dense + net.dense_bias
        np.add.at(sums, owner[part], logits * held[part, None])
        np.add.at(mass, owner[part], held[part])
    mean = sums / mass[:, None]
    prob = np.exp(mean - mean.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    best = prob.argmax(axis=1)
    names = [net.langs[b] if t and _LETTER.search(t) else "und" for b, t in zip(best, texts, strict=True)]
    return names, [0.0 if n == "und" and (not t or not _LETTER.search(t)) else float(p) for n, p, t in zip(names, prob.max(axis=1), texts, strict=True)]


def training_windows(labelled: DataFrame, docs_each: int = TRAIN_DOCS, each: int = TRAIN_WINDOWS, total: int = TRAIN_TOTAL) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of a sample of rows with doc_id, text and lang.

    The sample is bounded: of every language about ``docs_each`` documents, or its
    share of ``total`` where that is less, but one at least, picked by a hash of the
    id, with ``each`` windows spread over the whole text. Only windows come to the
    driver.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000))
    counts = {r.lang: r for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    langs = sorted(counts)
    docs_each = min(docs_each, max(1, total // len(langs)))
    # the first place is always below the bound, so that no language is left out by chance
    bounds = [(lang, max(int(1_000_000 * min(1.0, docs_each / r.n)), r.least + 1)) for lang, r in counts.items()]
    picked = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound bigint"))
    sample = known.select("lang", "text", place.alias("place")).join(picked, "lang").where("place < bound")

    def run(batch: pa.RecordBatch):
        for block in blocks(batch):
            out, of = [], []
            for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist(), strict=True):
                t = prepared(text)
                last = max(0, len(t) - WINDOW)
                for s in sorted({last * i // max(1, each - 1) for i in range(each)}):
                    out.append(t[s : s + WINDOW].tobytes().ljust(WINDOW))
                    of.append(lang)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(of, pa.string()), "window": pa.array(out, pa.binary())})

    rows = sorted((r.lang, bytes(r.window)) for r in map_arrow(sample.select("lang", "text"), run, "lang string, window binary").collect())
    x = np.frombuffer(b"".join(w for _, w in rows), dtype=np.uint8).reshape(-1, WINDOW)
    number = {lang: i for i, lang in enumerate(langs)}
    return x, np.array([number[lang] for lang, _ in rows], dtype=np.int64), langs


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, learn_from: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score (0 to 1) for each row of ``docs``; a map.

    ``learn_from`` has doc_id, text and lang. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text if nothing could be learned. Repeated
    rows are predicted alike; a language in ``docs`` is never looked at.
    """
    x, y, langs = training_windows(learn_from)
    net = train(x, y, langs) if langs else None
    shared = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(*dict.fromkeys((*keep, "text")))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in keep] + ["lang_pred string", "score double"]
    folded: list = []  # made once in each task

    def run(batch: pa.RecordBatch):
        net = shared.value
        if net and not folded:
            folded.append(net.tables())
        for block in blocks(batch):
            texts = block.column("text").to_pylist()
            names, scores = predict(net, folded[0], texts) if net else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_pydict({k: block.column(k) for k in keep} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return map_arrow(source, run, ", ".join(fields))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(~held_out()).select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
