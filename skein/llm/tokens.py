"""Token counts by a map-side lookup in two tiers.

A text is split into pre-tokens as the tokenizer would. Most of them are a few
frequent strings, whose lengths are in a broadcast table of bounded size; the
rest is encoded once and kept in a bounded cache of the worker. The pre-tokens of
texts are never shuffled; of each task a summary of ``SUMMARY`` frequent words goes
up a tree of merges, to fill the first tier. The tables only save work: with any of
them empty the counts are the same.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, map_batches, merged_in_tree, table

#: Entries of the broadcast table, of a task's summary, and of a worker's cache.
FREQUENT, SUMMARY, CACHE = 50_000, 4_000, 400_000
#: Code points handled at once within a text.
CHUNK_CHARS = 1 << 16

#: Characters for which Python and the tokenizer agree on NFC, lower case and kind by
#: any version of Unicode: up to Latin Extended-A, without the dotted capital I,
#: and common punctuation.
_PLAIN = regex.compile(r"[\x00-įı-ſ‐-‧‰-⁞€]*")
_CUT = regex.compile(r"(?<=[^\s])(?=[ \n])")

_state: dict[int, tuple] = {}


@lru_cache
def unsure() -> frozenset[str]:
    """Characters that are white space, a letter or a number for only one of ``regex`` and the tokenizer, whose versions of Unicode differ."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found: set[str] = set()
    for kind in (r"\s+", r"\p{L}+", r"\p{N}+"):
        change = np.zeros(len(every) + 1, dtype=bool)  # where one of them, but not both, begins or ends a run
        for runs in ([m.span() for m in regex.finditer(kind, every)], [at for _, at in Split(Regex(kind), "removed", invert=True).pre_tokenize_str(every)]):
            change[np.array(runs, dtype=np.int64).ravel()] ^= True
        found.update(every[i] for i in np.flatnonzero(np.logical_xor.accumulate(change[:-1])).tolist())
    return frozenset(found)


class WordSplitter:
    """Special strings, normalizer and pre-tokenizer of a tokenizers file of this kind: NFC, white space, lower case; a split pattern; bytes."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        pre = [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or pre != ["Split", "ByteLevel"]:
            raise ValueError("not a word-level byte BPE file")
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True  # pre-tokens are ordinary text
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.tokenizer.normalizer = None  # pre-tokens are normalized; a second time would move marks that follow what was a dotted capital I
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.find(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())
        text = self.normalize(text)
        if unsure().isdisjoint(text):
            return self.find(text)
        return [text[a:z] for _, (a, z) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pretokens(self, text: str):
        """Lists of pre-tokens; a special string counts on its own: None."""
        if self.cut_special and "<|" in text:
            at = 0
            for m in self.cut_special.finditer(text):
                yield from self.pretokens_of(text[at : m.start()])
                yield [None]
                at = m.end()
            text = text[at:]
        yield from self.pretokens_of(text)

    def pretokens_of(self, text: str):
        at = 0
        while len(text) - at > CHUNK_CHARS and (m := _CUT.search(text, at + CHUNK_CHARS)):
            yield self.split(text[at : m.start()])
            at = m.start()
        yield self.split(text[at:] if at else text)

    def lengths(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]


def splitter(raw: bytes) -> tuple[WordSplitter, dict]:
    """The splitter and the cache of this worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(raw)
    if key not in _state:
        _state[key] = (WordSplitter(raw), {})
    return _state[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def frequent_words(docs: DataFrame, top: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The most frequent white-space words of all texts.

    Each task counts its own words and passes on its ``summary`` most frequent as one
    row; rows are merged in a tree, the ``top`` most frequent of each merge passing on,
    so that no task holds more than the words of ``FAN_IN`` rows. Counts are lower
    bounds, which is enough to fill a lookup table.
    """
    kind = pa.schema([("all", pa.int32()), ("task", pa.int32()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
    schema = "all int, task int, words array<string>, n array<bigint>"

    def row(task: int, best: list[tuple[str, int]]) -> dict:
        return {"all": [0], "task": [task], "words": [[w for w, _ in best]], "n": [[n for _, n in best]]}

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for block in blocks(batch):
                for text in block.column("text").to_pylist():
                    if text:
                        seen.update(text.lower().split())
                if len(seen) > 60 * summary:  # keep what can still matter
                    seen = Counter(dict(seen.most_common(20 * summary)))
        yield pa.RecordBatch.from_pydict(row(TaskContext.get().partitionId(), seen.most_common(summary)), schema=kind)

    def merged(t: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for words, n in zip(t.column("words").to_pylist(), t.column("n").to_pylist(), strict=True):
            for w, k in zip(words, n, strict=True):
                seen[w] += k
        best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:top]
        return pa.table(row(t.column("task")[0].as_py(), best), schema=kind)

    parts = map_batches(docs.select("text"), run, schema)
    found = merged_in_tree(parts, ["all"], merged, schema, docs.rdd.getNumPartitions()).select("words").collect()
    return [w for r in found for w in r.words]


def frequent_lengths(docs: DataFrame, raw: bytes, top: int = FREQUENT) -> dict[str, int]:
    """Pre-token to number of tokens, for at most ``top`` of them: the first tier."""
    split, _ = splitter(raw)
    words = frequent_words(docs, top)
    found = list(dict.fromkeys(p for w in words for part in split.pretokens_of(w) for p in part))[:top]
    return dict(zip(found, split.lengths(found), strict=True))


def count_tokens(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), frequent: dict[str, int] | None = None) -> DataFrame:
    """``keep``, ``n_bytes`` (UTF-8) and ``n_tokens`` for each row of ``docs``; a map, without a shuffle.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows and null keys pass
    through; other columns are ignored. ``frequent`` is the first tier; None has it
    built from all texts.
    """
    spark = docs.sparkSession
    raw = read_vocabulary(vocabulary)
    shared = spark.sparkContext.broadcast((raw, frequent_lengths(docs, raw) if frequent is None else frequent))
    source = docs.select(*dict.fromkeys((*keep, "text")))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in keep] + ["n_bytes bigint", "n_tokens bigint"]

    def run(batch: pa.RecordBatch):
        raw, first = shared.value
        split, cache = splitter(raw)
        for block in blocks(batch):
            if len(cache) > CACHE:
                cache.clear()
            counts, pending = [], []
            unknown: dict[str, None] = {}
            for text in block.column("text").to_pylist():
                total = 0
                missed: list[str] = []
                for part in split.pretokens(text or ""):
                    if part == [None]:
                        total += 1
                        continue
                    for p in part:
                        n = first.get(p) or cache.get(p)
                        if n:
                            total += n
                        else:
                            missed.append(p)
                unknown.update(dict.fromkeys(missed))
                counts.append(total)
                pending.append(missed)
            if unknown:
                new = list(unknown)
                cache.update(zip(new, split.lengths(new), strict=True))
                counts = [n + sum(map(cache.__getitem__, missed)) for n, missed in zip(counts, pending, strict=True)]
            size = pa.compute.fill_null(pa.compute.binary_length(block.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({k: block.column(k) for k in keep} | {"n_bytes": size, "n_tokens": pa.array(counts, pa.int64())})

    return map_arrow(source, run, ", ".join(fields))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
