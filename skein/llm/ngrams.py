"""Language-model scores: stupid backoff over word unigrams and bigrams, computed relationally.

A document's score is the sum over its words of ln S(w | v), where v is the word
before: S is c(v w) / c(v) where the corpus has the bigram at least ``MIN_COUNT``
times, and else ``BACKOFF * c(w) / N``; the first word has c(w) / N. All counts are
those of the whole corpus. Words are runs without ASCII white space, A-Z in lower
case.

Three joins give each n-gram of a document its counts, and sums by document follow:

* Bigrams: documents' distinct bigrams are partitioned by a hash. A partition's
  count table is the sum by bigram of what arrives there; it is joined to the same
  rows in place, so that bigrams travel once, packed in compressed columns.
* Frequent bigrams, of which a partition would get a row from nearly every
  document, are found by bounded summaries, counted exactly and broadcast: a
  million at most.
* Words: the count table of words is partitioned by a hash. Words that are more than
  one in ``MAX_WORDS`` of all occurrences, of which there are at most that many, are
  broadcast; all others are rare by definition, and what a bigram needs of them is
  joined in rows, without hot keys.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, map_batches, map_groups, persisted, table, text_bytes
from .texthash import ngram_hashes, word_hashes

BACKOFF, MIN_COUNT = 0.4, 2
#: N-grams of a partition, about, and of a task's rows.
BUCKET, FLUSH = 2_000_000, 900_000
#: Words whose counts are broadcast, at most: packed in about 7 bytes, 12 in a worker.
MAX_WORDS = 1 << 23
#: Frequent bigrams: entries of a task's summary, occurrences in a task at least, in all at least.
SUMMARY, LOCAL_HOT, HOT = 16384, 8, 1024

_U4, _U8, _I4, _I8, _F8 = (np.dtype(x) for x in ("<u4", "<u8", "<i4", "<i8", "<f8"))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as byte planes, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns), 1)


def _unpack(raw: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8) if raw else np.zeros(0, np.uint8)
    n = len(data) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        planes = data[at : at + n * k.itemsize].reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(k).ravel())
        at += n * k.itemsize
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # by range, so that sorted hashes are sorted by bucket


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(h, return_inverse=True)
    return names, np.bincount(at, weights=n, minlength=len(names)).astype(np.int64)


def _split(h: np.ndarray, buckets: int):
    """Slices of sorted hashes by bucket."""
    b = _bucket(h, buckets)
    names, first = np.unique(b, return_index=True)
    return list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(b)][: len(first)], strict=True))


def _words(block: pa.RecordBatch):
    """Hash of each word, of the bigram that it ends (0 at a text's start), and the row of each."""
    words, begins = word_hashes(text_bytes(block))
    row = np.repeat(np.arange(block.num_rows), np.diff(begins))
    pairs = np.zeros(len(words), dtype=np.uint64)
    pairs[1:] = ngram_hashes(words, 2)
    starts = begins[:-1][np.diff(begins) > 0]
    pairs[starts] = 0
    return words, pairs, row, starts


def word_counts(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The count table of all words, packed by range of hashes (total occurrences, data), and h, n of bigrams that are frequent in some task (lower bounds)."""

    def run(batches):
        names, counts, size = [], [], 0
        pairs_seen: Counter = Counter()

        def flush():
            h, n = _summed(np.concatenate(names), np.concatenate(counts))
            parts = _split(h, buckets)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "data": pa.array([_pack(h[a:z], n[a:z]) for _, a, z in parts], pa.binary())})

        for batch in batches:
            for block in blocks(batch):
                words, pairs, _, _ = _words(block)
                h, n = np.unique(words, return_counts=True)
                names.append(h)
                counts.append(n.astype(np.int64))
                size += len(h)
                h, n = np.unique(pairs[pairs > 0], return_counts=True)
                pairs_seen.update(dict(zip(h[n > 1].tolist(), n[n > 1].tolist(), strict=True)))
                if len(pairs_seen) > 32 * SUMMARY:
                    pairs_seen = Counter(dict(pairs_seen.most_common(8 * SUMMARY)))
                if size > FLUSH:
                    yield flush()
                    names, counts, size = [], [], 0
        if names:
            yield flush()
        best = [(h, n) for h, n in pairs_seen.most_common(SUMMARY) if n >= LOCAL_HOT]
        if best:
            data = _pack(np.array([h for h, _ in best], np.uint64), np.array([n for _, n in best], np.int64))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1 - TaskContext.get().partitionId() % 256], pa.int32()), "data": pa.array([data], pa.binary())})

    def total(t: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), _U8, _I8) for x in t.column("data")]
        h, n = _summed(np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts]))
        if t.column("bucket")[0].as_py() < 0:
            return pa.table({"pair": pa.array([True] * len(h)), "h": pa.array(h.view(np.int64)), "total": pa.array(n), "data": pa.nulls(len(h), pa.binary())})
        return pa.table({"pair": [False], "h": pa.nulls(1, pa.int64()), "total": [int(n.sum())], "data": pa.array([_pack(h, n)], pa.binary())})

    rows = map_batches(docs.select("text"), run, "bucket int, data binary")
    out = persisted(map_groups(docs.sparkSession, rows.groupBy("bucket"), total, "pair boolean, h bigint, total bigint, data binary"))
    return out.where("not pair").select("total", "data"), out.where("pair").groupBy("h").agg(F.sum("total").alias("n"))


def frequent_counts(words: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the words that occur ``least`` times or more."""

    def picked(batch: pa.RecordBatch):
        for raw in batch.column("data").to_pylist():
            h, n = _unpack(raw, _U8, _I8)
            yield pa.RecordBatch.from_pydict({"data": pa.array([_pack(h[n >= least], n[n >= least])], pa.binary())})

    parts = [_unpack(bytes(r.data), _U8, _I8) for r in map_arrow(words.select("data"), picked, "data binary").collect()]
    h = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
    order = np.argsort(h, kind="stable")
    return h[order], n[order].astype(np.uint32) if len(n) and n.max() < 1 << 32 else n[order]


def rare_counts(words: DataFrame, least: int) -> DataFrame:
    """word, count of the words that occur less than ``least`` times."""

    def unpacked(batch: pa.RecordBatch):
        for raw in batch.column("data").to_pylist():
            h, n = _unpack(raw, _U8, _I8)
            yield pa.RecordBatch.from_pydict({"word": pa.array(h[n < least].view(np.int64)), "count": pa.array(n[n < least])})

    return map_arrow(words.select("data"), unpacked, "word bigint, count bigint")


def exact_counts(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Occurrences in all texts of the bigrams ``wanted`` (sorted, bounded)."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        known = shared.value
        n = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for block in blocks(batch):
                _, pairs, _, _ = _words(block)
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                n += np.bincount(at[known[at] == pairs], minlength=len(known))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "n": pa.array(n[at])})

    n = np.zeros(len(wanted), dtype=np.int64)
    for r in map_batches(docs.select("text"), run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        n[r.i] = r.n
    return n


def stupid_backoff(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), max_words: int = MAX_WORDS) -> DataFrame:
    """``keep``, n_words, n_backoff (places that back off), log_score (sum of natural logarithms) and mean_log_score for each row of ``docs``.

    A null, empty or blank text has no words, log_score 0 and a null mean. Repeated
    rows are documents of their own and count as often. Other columns are ignored.
    The sums' last digits depend on the order of addition.
    """
    spark: SparkSession = docs.sparkSession
    chars = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    buckets = max(2, -(-chars // 5 // BUCKET))
    words, seen = word_counts(docs, buckets)
    n_words = int(words.agg(F.sum("total")).first()[0] or 0)
    least = n_words // max_words + 1  # n_words / least words at most occur so often
    hot = np.sort(np.array([r.h for r in seen.where(F.col("n") >= max(HOT, n_words // 1_000_000)).select("h").collect()], dtype=np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((*frequent_counts(words, least), hot, exact_counts(docs, hot), n_words))
    sums = persisted(bigram_sums(docs, keep, shared, n_words, buckets))
    asked = asked_of_rare_words(sums)
    answers = asked.join(rare_counts(words, least), "word").groupBy("chunk", "doc").agg(F.sum(F.col("weight") * F.log("count")).alias("s"))
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("doc", "s")).alias("rare"))
    return by_document(sums, answers, keep, docs)


def _lookup(names: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of hashes, 0 where unknown."""
    if not len(names):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return np.where(names[at] == h, values[at], 0).astype(np.int64)


#: Columns of a chunk's bigrams on their way: hash, document of the chunk, times, counts of both words (0: rare, to be asked for).
_BIGRAMS = (_U8, _U4, _U4, _I8, _I8)
#: What a document asks of a rare word: document of the chunk, word, times that the logarithm of its count adds to the score.
_ASKED = (_U4, _U8, _I4)
#: A partition's part of a document's score, and its places that back off.
_SUMS = (_U4, _F8, _U4)


def bigram_sums(docs: DataFrame, keep: tuple[str, ...], shared, n_words: int, buckets: int) -> DataFrame:
    """Chunks of documents: a row with keys, words and what is known at once, and a row of partial sums from each partition of bigrams; either may ask for rare words."""
    source = docs.select(F.struct(*keep).alias("_k"), "text")
    key_kind = source.schema["_k"].dataType.simpleString()

    def emit(batches):
        names, counts, hot, hot_n, _ = shared.value
        part = TaskContext.get().partitionId()
        chunk = size = 0
        held = _Chunk()

        def flush():
            name = (part << 24) | chunk
            head = {"bucket": pa.array([-1 - name % 65536], pa.int32()), "chunk": pa.array([name], pa.int64()), "data": pa.array([_pack(*held.sums())], pa.binary()), "rare_before": pa.array([_pack(*held.asked())], pa.binary()), "rare_own": pa.nulls(1, pa.binary())}
            yield pa.RecordBatch.from_pydict(head | {"keys": pa.array([held.keys], pa.list_(held.kind)), "words": pa.array([held.words], pa.list_(pa.int64()))})
            rows = list(held.partitions(buckets))
            some = {"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([name] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary()), "rare_before": pa.array([r[2] for r in rows], pa.binary()), "rare_own": pa.array([r[3] for r in rows], pa.binary())}
            yield pa.RecordBatch.from_pydict(some | {"keys": pa.nulls(len(rows), pa.list_(held.kind)), "words": pa.nulls(len(rows), pa.list_(pa.int64()))})

        for batch in batches:
            for block in blocks(batch):
                size += held.add(block, names, counts, hot, hot_n, n_words)
                if size >= FLUSH:
                    yield from flush()
                    held, size, chunk = _Chunk(), 0, chunk + 1
        if held.keys:
            yield from flush()

    def joined(t: pa.Table) -> pa.Table:
        """Joins a partition's count table to its bigrams; a row for each chunk."""
        if t.column("bucket")[0].as_py() < 0:
            return t.select(["chunk", "keys", "words", "data", "rare_before"]).rename_columns(["chunk", "keys", "words", "sums", "asked"])
        parts = [_unpack(d.as_py(), *_BIGRAMS) for d in t.column("data")]
        starts = np.cumsum([0] + [len(p[0]) for p in parts])
        names, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([p[2] for p in parts]), minlength=len(names))
        sums, asked = [], []
        for p, rare_before, rare_own, a, z in zip(parts, t.column("rare_before"), t.column("rare_own"), starts[:-1], starts[1:], strict=True):
            c = count[at[a:z]]
            _, doc, times, before, own = p
            held = c >= MIN_COUNT
            known = lambda x: np.log(np.maximum(x, 1))  # noqa: E731  nothing yet for a rare word
            s = np.where(held, np.log(c) - known(before), np.log(BACKOFF / n_words) + known(own)) * times
            docs_here, inverse = np.unique(doc, return_inverse=True)
            sums.append(_pack(docs_here, np.bincount(inverse, weights=s), np.bincount(inverse, weights=~held * times).astype(np.uint32)))
            word = np.zeros((2, len(c)), dtype=np.uint64)
            word[0, before == 0], word[1, own == 0] = *_unpack(rare_before.as_py(), _U8), *_unpack(rare_own.as_py(), _U8)
            i = np.flatnonzero(np.where(held, before, own) == 0)
            asked.append(_pack(doc[i], np.where(held, word[0], word[1])[i], np.where(held[i], -1, 1).astype(np.int32) * times[i].astype(np.int32)))
        n = len(parts)
        return pa.table({"chunk": t.column("chunk"), "keys": pa.nulls(n, t.schema.field("keys").type), "words": pa.nulls(n, t.schema.field("words").type), "sums": pa.array(sums, pa.binary()), "asked": pa.array(asked, pa.binary())})

    rows = map_batches(source, emit, f"bucket int, chunk bigint, data binary, rare_before binary, rare_own binary, keys array<{key_kind}>, words array<bigint>")
    return map_groups(docs.sparkSession, rows.groupBy("bucket"), joined, f"chunk bigint, keys array<{key_kind}>, words array<bigint>, sums binary, asked binary")


class _Chunk:
    """Documents that a task gathers: their keys, what is known of their scores, and their other bigrams."""

    def __init__(self):
        self.keys: list = []
        self.words: list[int] = []
        self.kind = None
        self._known: list[np.ndarray] = []
        self._first: list[tuple[np.ndarray, np.ndarray]] = []  # rare first words: document and word
        self._bigrams: list[tuple[np.ndarray, ...]] = []

    def add(self, block: pa.RecordBatch, names, counts, hot, hot_n, n_words: int) -> int:
        """The number of bigrams that are left to be joined."""
        words, pairs, row, starts = _words(block)
        n = _lookup(names, counts, words)
        base, docs = len(self.keys), block.num_rows
        known = np.zeros(docs)
        known[row[starts]] = np.log(np.maximum(n[starts], 1) / max(1, n_words))
        rare = starts[n[starts] == 0]
        self._first.append((row[rare] + base, words[rare]))
        before, last = np.append(0, n[:-1])[: len(n)], np.append(np.uint64(0), words[:-1])[: len(n)]
        c = _lookup(hot, hot_n, pairs)
        on = (c > 0) & (before > 0) & (pairs > 0)
        known += np.bincount(row[on], weights=np.log(c[on] / before[on]), minlength=docs)
        off = np.flatnonzero(~on & (pairs > 0))
        order = off[np.lexsort((pairs[off], row[off]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (pairs[order][1:] != pairs[order][:-1]) | (row[order][1:] != row[order][:-1])
        first = np.flatnonzero(new)
        at = order[first]
        times = np.diff(np.append(first, len(order)))
        self._bigrams.append((pairs[at], (row[at] + base).astype(np.uint32), times.astype(np.uint32), before[at], n[at], last[at], words[at]))
        self.kind = block.column("_k").type
        self.keys += block.column("_k").to_pylist()
        self.words += np.bincount(row, minlength=docs).tolist()
        self._known.append(known)
        return len(at)

    def sums(self) -> tuple[np.ndarray, ...]:
        known = np.concatenate(self._known)
        return np.arange(len(known), dtype=np.uint32), known, np.zeros(len(known), np.uint32)

    def asked(self) -> tuple[np.ndarray, ...]:
        doc, word = (np.concatenate(x) for x in zip(*self._first, strict=True))
        return doc.astype(np.uint32), word, np.ones(len(doc), np.int32)

    def partitions(self, buckets: int):
        """Number, packed bigrams, with hashes as differences, and the words whose counts aren't known, of each partition."""
        columns = [np.concatenate(x) for x in zip(*self._bigrams, strict=True)]
        self._bigrams.clear()
        order = np.argsort(columns[0], kind="stable")
        columns = [x[order] for x in columns]
        for b, a, z in _split(columns[0], buckets):
            h, doc, times, before, own, v, w = (x[a:z] for x in columns)
            yield b, _pack(np.diff(h, prepend=np.uint64(0)), doc, times, before, own), _pack(v[before == 0]), _pack(w[own == 0])


def asked_of_rare_words(sums: DataFrame) -> DataFrame:
    """chunk, doc, word, weight."""

    def run(batch: pa.RecordBatch):
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            doc, word, weight = _unpack(raw, *_ASKED)
            if len(doc):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(doc), pa.int64()), "doc": pa.array(doc.astype(np.int64)), "word": pa.array(word.view(np.int64)), "weight": pa.array(weight.astype(np.int64))})

    return map_arrow(sums.select("chunk", "asked"), run, "chunk bigint, doc bigint, word bigint, weight bigint")


def by_document(sums: DataFrame, answers: DataFrame, keep: tuple[str, ...], docs: DataFrame) -> DataFrame:
    """The sums of each document; answers has chunk and rare (doc, s)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(t: pa.Table) -> pa.Table:
        head = next(i for i in range(len(t)) if t.column("keys")[i].is_valid)
        n = len(t.column("keys")[head])
        score, back = np.zeros(n), np.zeros(n, dtype=np.int64)
        for raw, rare in zip(t.column("sums").to_pylist(), t.column("rare"), strict=True):
            if rare.is_valid:
                np.add.at(score, np.asarray(rare.values.field("doc")), np.asarray(rare.values.field("s")))
            else:
                doc, s, off = _unpack(raw, *_SUMS)
                score[doc] += s
                back[doc] += off
        struct = t.column("keys")[head].values
        words = pa.array(t.column("words")[head].as_py(), pa.int64())
        return pa.table({k: struct.field(i) for i, k in enumerate(keep)} | {"n_words": words, "n_backoff": pa.array(back), "log_score": pa.array(score)})

    some = sums.select("chunk", "keys", "words", "sums", F.lit(None).cast("array<struct<doc: bigint, s: double>>").alias("rare"))
    more = answers.select("chunk", F.lit(None).cast(sums.schema["keys"].dataType).alias("keys"), F.lit(None).cast("array<bigint>").alias("words"), F.lit(None).cast("binary").alias("sums"), "rare")
    out = map_groups(docs.sparkSession, some.unionByName(more).groupBy("chunk"), run, f"{fields}, n_words bigint, n_backoff bigint, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores rounded to where the order of addition doesn't show."""
    out = stupid_backoff(table(spark, sf_dir, "documents"))
    return out.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})
