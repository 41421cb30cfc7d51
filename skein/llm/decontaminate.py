"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a text with at most e edits leaves at
least m - q + 1 - e q of its q-grams intact, and all of them on diagonals (place in
the text less place in the passage) that differ by e at most. So shared q-grams
are counted in bands of 2 (e + 1) diagonals that overlap by half, which any such
occurrence falls into whole; bands that reach the bound are aligned, within the
band, against the text. All else is ruled out without an alignment, and no
occurrence within the budget is lost.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import blocks, map_arrow, persisted, table

#: Characters of a q-gram, and edits allowed a character of the passage.
Q, EDIT_RATE = 8, 0.1
#: Characters of passages whose index a worker holds (about 20 bytes each); more are searched for in several rounds.
MAX_CHARS = 8 << 20
#: Shared q-grams that are held at once.
MAX_HITS = 1 << 20
#: Documents with leaks that are broadcast after several rounds; more are joined.
MAX_BROADCAST = 500_000
_FLAG_BITS = 22
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def qgram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each run of Q = 8 characters, by doubling."""
    h = points + np.uint64(1)
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):
            if len(h) <= step:
                return h[:0]
            h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * _MUL + h[step:]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Passages:
    """An index of the q-grams of passages."""

    ids: list
    texts: list[str]
    points: list[np.ndarray]
    budget: np.ndarray  # edits
    bound: np.ndarray  # q-grams that must be shared
    short: list[tuple[int, str]]  # passages under a q-gram, found exactly
    gram: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # of each, where its places begin
    item: np.ndarray
    offset: np.ndarray
    flags: np.ndarray
    key: np.ndarray | None = None  # of each place, q-gram and passage; made when asked for

    @classmethod
    def build(cls, items: list[tuple[object, str | None]], rate: float = EDIT_RATE) -> Passages:
        ids, texts, points, short = [], [], [], []
        for i, text in items:
            t = normalized(text)
            if t:
                if len(t) < Q:
                    short.append((len(ids), t))
                ids.append(i)
                texts.append(t)
                points.append(_points(t))
        m = np.array([len(p) for p in points], dtype=np.int64)
        budget = np.maximum(0, np.minimum((rate * m).astype(np.int64), (m - Q) // Q))
        hashes = [qgram_hashes(p) for p in points]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in hashes])
        offset = np.concatenate([np.arange(len(x), dtype=np.int32) for x in hashes]) if hashes else np.zeros(0, np.int32)
        order = np.argsort(h, kind="stable")
        gram, first = np.unique(h[order], return_index=True)
        flags = np.zeros(1 << _FLAG_BITS, dtype=bool)
        flags[(gram >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] = True
        return cls(ids, texts, points, budget, m - Q + 1 - budget * Q, short, gram, np.append(first, len(h)), item[order], offset[order], flags)

    def matched(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the q-grams that passages have too, and the number of each q-gram."""
        h = qgram_hashes(points)
        at = np.flatnonzero(self.flags[(h >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)])
        if not len(at) or not len(self.gram):
            return (np.zeros(0, np.int64),) * 2
        g = np.searchsorted(self.gram, h[at])
        g[g == len(self.gram)] = 0
        same = self.gram[g] == h[at]
        return at[same], g[same]

    def _range(self, g: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each q-gram, first place in a passage from low to high - 1, and how many there are."""
        if (low, high) == (0, len(self.ids)):
            return self.first[g], self.first[g + 1] - self.first[g]
        if self.key is None:
            self.key = np.repeat(np.arange(len(self.gram)), np.diff(self.first)) * len(self.ids) + self.item
        first = np.searchsorted(self.key, g * len(self.ids) + low)
        return first, np.searchsorted(self.key, g * len(self.ids) + high) - first

    def search(self, texts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each normalized text: passage to edits and place (of the start, within the edits) of its best occurrence."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for n, t in enumerate(texts):
            for k, s in self.short:
                if (at := t.find(s)) >= 0:
                    found[n][k] = (0, at)
        whole = [_points(t) for t in texts]
        starts = np.cumsum([0] + [len(p) + Q for p in whole])  # apart by a gap that no q-gram of a passage has
        joined = np.zeros(starts[-1], dtype=np.uint64)
        for s, p in zip(starts[:-1], whole, strict=True):
            joined[s : s + len(p)] = p
        at, g = self.matched(joined)
        doc = np.searchsorted(starts, at, side="right") - 1
        at -= starts[doc]
        hits = np.cumsum(np.bincount(doc, weights=self.first[g + 1] - self.first[g], minlength=len(texts)))
        best: dict[tuple[int, int], list[int]] = defaultdict(list)
        a = 0
        while a < len(texts):  # runs of documents with few enough shared q-grams to hold
            z = max(a + 1, int(np.searchsorted(hits, (hits[a - 1] if a else 0) + MAX_HITS, side="right")))
            part = slice(*np.searchsorted(doc, [a, z]))
            self._bands(at[part], g[part], doc[part], 0, len(self.ids), best)
            a = z
        for (d, k), bands in best.items():
            e = int(self.budget[k])
            if (at := texts[d].find(self.texts[k])) >= 0:
                found[d][k] = (0, at)
                continue
            for b in sorted(bands):
                got = banded_alignment(self.points[k], whole[d], b * (e + 1) - e, (b + 2) * (e + 1) + e)
                if got[0] <= e and got < found[d].get(k, (e + 1, 0)):
                    found[d][k] = got
        return found

    def _bands(self, at: np.ndarray, g: np.ndarray, doc: np.ndarray, low: int, high: int, best: dict) -> None:
        """Adds, by document and passage from low to high - 1, the bands that share enough q-grams; band b holds diagonals from b * step to (b + 2) * step."""
        first, n = self._range(g, low, high)
        total = int(n.sum())
        if total > MAX_HITS and high - low > 1:
            middle = (low + high) // 2
            self._bands(at, g, doc, low, middle, best)
            self._bands(at, g, doc, middle, high, best)
            return
        if total > MAX_HITS and doc[0] != doc[-1]:
            for d in np.unique(doc):
                self._bands(at[doc == d], g[doc == d], doc[doc == d], low, high, best)
            return
        if total > MAX_HITS:  # one text and one passage: sums by band
            self._bands_of_one(at, first, n, int(doc[0]), low, best)
            return
        where = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
        item, doc, diagonal = self.item[where].astype(np.int64), np.repeat(doc, n), np.repeat(at, n) - self.offset[where]
        key = doc * len(self.ids) + item
        keys, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        enough = (count >= self.bound[keys % len(self.ids)])[inverse]
        doc, item, diagonal = doc[enough], item[enough], diagonal[enough]
        lowest = diagonal // (self.budget[item] + 1)
        for shift in (0, 1):
            band = lowest - shift
            base, span = (int(band.min()), int(np.ptp(band)) + 1) if len(band) else (0, 1)
            keys, count = np.unique((doc * len(self.ids) + item) * span + (band - base), return_counts=True)
            pair = keys // span
            enough = count >= self.bound[pair % len(self.ids)]
            for x, b in zip(pair[enough].tolist(), (keys % span + base)[enough].tolist(), strict=True):
                best[divmod(x, len(self.ids))].append(b)

    def _bands_of_one(self, at: np.ndarray, first: np.ndarray, n: np.ndarray, doc: int, item: int, best: dict) -> None:
        step = int(self.budget[item]) + 1
        base = -(len(self.points[item]) // step) - 2
        counts = np.zeros((int(at.max()) // step - base + 2, 2), dtype=np.int64)
        ends = np.cumsum(n)
        a = 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MAX_HITS, side="right")))
            k = n[a:z]
            where = np.repeat(first[a:z] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            band = (np.repeat(at[a:z], k) - self.offset[where]) // step - base
            counts[:, 0] += np.bincount(band, minlength=len(counts))
            counts[:, 1] += np.bincount(band - 1, minlength=len(counts))
            a = z
        for shift in (0, 1):
            best[doc, item] += (np.flatnonzero(counts[:, shift] >= self.bound[item]) + base).tolist()
        if not best[doc, item]:
            del best[doc, item]


def banded_alignment(passage: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits between the passage and a part of the text, on diagonals from low to high - 1, and about where it begins."""
    width, m, n = high - low, len(passage), len(text)
    far = m + 1
    k = np.arange(width)
    padded = np.full(m + width + 2, np.iinfo(np.uint64).max, dtype=np.uint64)  # text from place low on
    a, b = max(0, low), min(n, low + m + width)
    if a < b:
        padded[a - low : b - low] = text[a:b]
    place = low + k
    row = np.where((place >= 0) & (place <= n), 0, far)
    for i in range(m):
        place = low + i + 1 + k
        same = np.append(row[1:], far) + 1  # a character of the passage is missing
        new = np.minimum(row + (padded[i : i + width] != passage[i]), same)
        new = np.where((place >= 0) & (place <= n), new, far)
        row = k + np.minimum.accumulate(new - k)  # extra characters of the text
    at = int(row.argmin())
    return int(row[at]), max(0, low + at)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, max_chars: int = MAX_CHARS, name: str = "leaks", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with ``leaks``: array of (item_id, edits, start) of the passages that
    its text contains within the edit budget, ordered by item_id (nulls first); empty without.

    ``benchmark`` has item_id (of any type that has an order) and text. Both sides are
    compared in lower case with runs of white space as one blank; ``start`` counts
    characters of that form and is exact up to the edits. The budget is ``rate`` edits
    a character, less where a passage is so short that no q-gram need be shared;
    passages under Q characters are found exactly, and null or blank ones nowhere. A
    null text has no leaks. Repeated rows are searched alike; all columns are carried,
    and one of the result's name (``name``) is replaced.

    Passages are broadcast. Above ``max_chars`` characters that is done in blocks, with
    a pass over the texts for each; documents with leaks then join back by doc_id and a
    hash of the text.
    """
    docs = docs.drop(name)
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    rounds = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // max_chars))
    if rounds == 1:
        return _searched(docs, items, rate, name)
    keyed = docs.withColumn("__skein_h", F.xxhash64("text"))
    found = None
    for r in range(rounds):
        part = _searched(keyed.select("doc_id", "text", "__skein_h"), items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r), rate, "leaks").where(F.size("leaks") > 0).drop("text")
        found = part if found is None else found.union(part)
    kind = found.schema["leaks"].dataType.simpleString()
    by = found.groupBy(F.col("doc_id").alias("__skein_d"), F.col("__skein_h").alias("__skein_g")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaks")))).alias("__skein_leaks"))
    by = persisted(by)
    if by.count() <= max_broadcast:
        by = F.broadcast(by)
    same = F.col("doc_id").eqNullSafe(F.col("__skein_d")) & F.col("__skein_h").eqNullSafe(F.col("__skein_g"))
    return keyed.join(by, same, "left").select(*docs.columns, F.coalesce("__skein_leaks", F.array().cast(kind)).alias(name))


def _searched(docs: DataFrame, items: DataFrame, rate: float, name: str) -> DataFrame:
    """``docs`` with the leaks of passages that are few enough to be broadcast."""
    id_type = items.schema["item_id"].dataType
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("edits", pa.int64()), ("start", pa.int64())]))
    shared = docs.sparkSession.sparkContext.broadcast(sorted({(x.item_id, x.text) for x in items.collect()}, key=lambda x: (x[0] is not None, x if x[0] is not None else x[1])))
    index: list[Passages] = []  # built once in each task

    def run(batch: pa.RecordBatch):
        if not index:
            index.append(Passages.build(shared.value, rate))
        for block in blocks(batch):
            found = index[0].search([normalized(t) for t in block.column("text").to_pylist()])
            rows = [[{"item_id": index[0].ids[k], "edits": e, "start": s} for k, (e, s) in sorted(f.items())] for f in found]
            yield pa.RecordBatch.from_pydict({f.name: block.column(i) for i, f in enumerate(block.schema)} | {name: pa.array(rows, kind)})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` array<struct<item_id: {id_type.simpleString()}, edits: bigint, start: bigint>>"]
    return map_arrow(docs, run, ", ".join(fields))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    ids = F.transform("leaks", lambda x: x["item_id"])
    return found.select("doc_id", F.size("leaks").cast("bigint").alias("n_leaks"), (F.size("leaks") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["edits"])).alias("least_edits"))
