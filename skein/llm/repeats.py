"""Exact repeated strings by bucket-pointer refinement.

Texts are strings of bytes, or of words. A string of ``length`` symbols is repeated if
it starts at two places. Suffixes are not sorted one by one; they are first put in
buckets by a q-gram that the string itself picks (the least hash of its q-grams, the
leftmost of equals), so that equal strings are in one bucket, with the same offset to
the q-gram. Neighbouring starts with the same q-gram form a *segment*, of about half
of ``length - q`` starts:

1. Segments of equal symbols and offsets are counted, summed by task. Those found
   twice are repeated as a whole; those alone in their bucket aren't at all.
2. One of each of the others comes with its symbols to its bucket. There, starts are
   ranked by their q-grams and refined by the ranks of later offsets: ranks of two
   times q symbols come from pairs of ranks of q symbols, and so on recursively, each
   round reusing the ranks before it and leaving out starts that are alone. Starts
   whose full strings share a rank are repeated.
3. A bucket too large for a task is refined by more symbols first: its segments are
   cut at fixed offsets, and each piece goes to the bucket of the symbols that all of
   its strings have in common, down to single strings.

Each document then loses the bytes that its repeated strings cover. Nothing is
broadcast but what the planner finds small: the joins of segments, of the texts that
are read again and of results are shuffles at any size. Each step is written to the
shared store; what it read goes as soon as no later step needs it, and its shuffle
files go at its end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, discard, map_arrow, map_groups, named, persisted, shuffles_dropped, table, text_bytes
from .texthash import mixed, word_hashes

#: Bytes of texts handled at once, and symbols of a text.
BLOCK, PIECE = 1 << 19, 1 << 19
#: Segments of a bucket that one task refines, and of a task's buckets together, about.
BUCKET, TASK = 4_000, 4_000
#: Widths of offset ranges into which a large bucket's segments are cut, in turn.
CUTS = (64, 8, 1)

_RNG = np.random.default_rng(19931028)
_VALUES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Bytes:
    """Texts as strings of bytes."""

    kind = np.dtype(np.uint8)

    @staticmethod
    def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols, and where each text's begin (and all end)."""
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    @staticmethod
    def values(data: np.ndarray, which: int) -> np.ndarray:
        return _VALUES[which][data]


class Words:
    """Texts as strings of words without ASCII white space, A-Z in lower case, by their hashes."""

    kind = np.dtype(np.uint64)
    symbols = staticmethod(word_hashes)

    @staticmethod
    def values(data: np.ndarray, which: int) -> np.ndarray:
        return mixed(data ^ np.uint64(_BASES[which])) | np.uint64(1)


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, at least n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        base = _BASES[which]
        make = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, dtype=np.uint64)]), dtype=np.uint64)
        have = _powers[which] = (make(base), make(pow(base, -1, 1 << 64)))
    return have


class Hashes:
    """Hashes of any part of some symbols, by sums of powers."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.power, self.inverse = _power(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Of all parts of n symbols."""
        return mixed((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n] + np.uint64(n))


def _least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive entries."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, begin: np.ndarray, length: int, q: int, unit=Bytes) -> dict[str, np.ndarray]:
    """text, start, stop (first start past it), anchor (all in the text), bucket, and a 128-bit name (hi, lo) of symbols and offsets."""
    size = np.diff(begin)
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "stop", "anchor", "bucket", "hi", "lo")}
    first = Hashes(unit.values(data, 0))
    gram = first.grams(q)
    bits = max(1, int(len(gram)).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = _least_in_windows((gram & ~low) | np.arange(len(gram), dtype=np.uint64), length - q + 1)
    anchor = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= begin[owner + 1]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    at = np.flatnonzero(new & valid)
    edge = np.flatnonzero(new | ~valid)
    stop = np.append(edge, len(anchor))[np.searchsorted(edge, at, side="right")]
    a, text = anchor[at], owner[at]
    offsets = ((a - at) * (1 << 20) + (a - stop)).astype(np.uint64)  # of the q-gram from first and past start
    end = stop - 1 + length
    hi = mixed(first.of(at, end) + offsets)
    lo = mixed(Hashes(unit.values(data, 1), 1).of(at, end) + offsets)
    return {"text": text, "start": at - begin[text], "stop": stop - begin[text], "anchor": a - begin[text], "bucket": gram[a].view(np.int64), "hi": hi.view(np.int64), "lo": lo.view(np.int64)}


def segments_of(texts: list[bytes], length: int, q: int, unit=Bytes) -> dict[str, np.ndarray]:
    """The segments of all texts; a long text is cut into pieces that overlap by a string, so that no more than a piece is hashed at once."""
    data, begin = unit.symbols(texts)
    pieces = [(n, at, min(z - a, at + PIECE + length - 1)) for n, (a, z) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)) for at in range(0, max(0, z - a - length + 1), PIECE)]
    found, run, size = [], [], 0
    for k, (n, at, z) in enumerate(pieces):
        run.append((n, at, z))
        size += z - at
        if size >= PIECE or k == len(pieces) - 1:
            part = segments(np.concatenate([data[begin[n] + a : begin[n] + z] for n, a, z in run]), np.cumsum([0] + [z - a for _, a, z in run]), length, q, unit)
            which = np.array(run, dtype=np.int64)[part["text"]].reshape(-1, 3)
            found.append(part | {"text": which[:, 0]} | {c: part[c] + which[:, 1] for c in ("start", "stop", "anchor")})
            run, size = [], 0
    return {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in ("text", "start", "stop", "anchor", "bucket", "hi", "lo")}


def repeated_starts(spans: list[np.ndarray], counts: np.ndarray, owner: np.ndarray, length: int, q: int, unit=Bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each span, which of its first ``counts`` places start a string of ``length`` symbols that starts at another of those places too; and which of these do so in a span of another owner.

    Bucket-pointer refinement over all places of all spans: a rank of twice as many
    symbols is that of a pair of ranks, and a place whose rank is unique stays so.
    """
    size = np.array([len(s) for s in spans], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.concatenate(spans) if spans else np.zeros(0, unit.kind)
    room = np.repeat(begin[1:], size) - np.arange(len(data))  # symbols left in the span
    rank = np.zeros(len(data), dtype=np.int64)  # 0: no other place has these symbols
    have = q
    grams = Hashes(unit.values(data, 0)).grams(q) if len(data) >= q else np.zeros(0, np.uint64)
    live = np.flatnonzero(room[: len(grams)] >= q)
    live = _ranked(rank, live, (grams[live],))
    while have < length:
        step = min(have, length - have)  # the last round may overlap the one before
        both = live[(room[live] >= have + step)]
        pointer = rank[both + step]  # the bucket of the later offset
        both, pointer = both[pointer > 0], pointer[pointer > 0]
        own = rank[both]
        rank = np.zeros_like(rank)
        live = _ranked(rank, both, (own, pointer))
        have += step
    wanted = np.zeros(len(data), dtype=bool)
    wanted[live] = True
    if not spans:
        return [], []
    start = np.concatenate([np.arange(c) + b for b, c in zip(begin[:-1].tolist(), counts.tolist(), strict=True)])
    of = np.repeat(owner, counts)
    _, inverse, n = np.unique(rank[start], return_inverse=True, return_counts=True)
    hit = (n[inverse] > 1) & wanted[start]
    least, most = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
    np.minimum.at(least, inverse, of)
    np.maximum.at(most, inverse, of)
    cuts = np.cumsum(counts)[:-1]
    return np.split(hit, cuts), np.split(hit & (least != most)[inverse], cuts)


def _ranked(rank: np.ndarray, at: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Writes ranks from 1 of the places ``at`` by ``keys`` where two places share them; those places."""
    if not len(at):
        return at
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(at), dtype=bool)
    change[0] = True
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    group = np.cumsum(change)
    shared = np.bincount(group)[group] > 1
    found = at[order][shared]
    rank[found] = group[shared]
    return np.sort(found)


_SPAN = "bucket bigint, ref bigint, start bigint, stop bigint, anchor bigint, hi bigint, lo bigint, span binary"
_RANGE = "ref bigint, start bigint, stop bigint, other boolean"


def repeated_ranges(keyed: DataFrame, length: int, q: int, unit=Bytes, bucket_limit: int = BUCKET, task_size: int = TASK) -> DataFrame:
    """ref, ranges (start, stop) and other: starts, stop excluded, of repeated strings in the texts with that ref, and whether a text of another ref has one of them.

    ``keyed`` has ref, which is a name of the text's document, and text.
    """

    def cut(batch: pa.RecordBatch):
        for block in blocks(batch, limit=BLOCK):
            found = segments_of(text_bytes(block), length, q, unit)
            ref = np.asarray(block.column("ref"))[found.pop("text")]
            yield pa.RecordBatch.from_pydict({"ref": pa.array(ref, pa.int64())} | {k: pa.array(v, pa.int64()) for k, v in found.items()})

    parts = persisted(map_arrow(keyed, cut, "ref bigint, start bigint, stop bigint, anchor bigint, bucket bigint, hi bigint, lo bigint"))
    one = F.min(F.struct("ref", "start", "stop", "anchor")).alias("one")
    kinds = persisted(parts.groupBy("bucket", "hi", "lo").agg(F.count(F.lit(1)).alias("n"), one, F.max("ref").alias("last")))
    # whole segments found twice
    whole = kinds.where("n > 1").select("hi", "lo", (F.col("one.ref") != F.col("last")).alias("other"))
    ranges = [persisted(parts.join(whole, ["hi", "lo"]).select("ref", "start", "stop", "other"))]
    tasks = max(1, -(-parts.count() // 200_000))
    discard(parts)
    # one segment of each kind in buckets with several kinds
    several = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    chosen = persisted(kinds.join(several, "bucket").select("bucket", "hi", "lo", "one.*"))
    discard(kinds)
    picked = chosen.groupBy(F.col("ref").alias("_ref")).agg(F.collect_list(F.struct("bucket", "start", "stop", "anchor", "hi", "lo")).alias("parts"))
    source = keyed.join(picked, F.col("ref") == F.col("_ref")).select("ref", "text", "parts")

    def read(batch: pa.RecordBatch):
        for block in blocks(batch, limit=BLOCK):
            out: dict[str, list] = {k: [] for k in ("bucket", "ref", "start", "stop", "anchor", "hi", "lo", "span")}
            data, begin = unit.symbols(text_bytes(block))
            for ref, at, parts in zip(block.column("ref").to_pylist(), begin.tolist(), block.column("parts").to_pylist(), strict=False):
                for p in parts:
                    for k, v in (*p.items(), ("ref", ref), ("span", data[at + p["start"] : at + p["stop"] - 1 + length].tobytes())):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "span" else pa.int64()) for k, v in out.items()})

    spans = persisted(map_arrow(source, read, _SPAN).dropDuplicates(["bucket", "hi", "lo"]))  # repeated rows give the same span twice
    discard(chosen)
    for width in (*CUTS, None):
        large = persisted(spans.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > bucket_limit).select("bucket"))
        if width is None or large.isEmpty():
            ranges.append(persisted(_refined(spans, length, q, unit, task_size)))
            discard(spans, large)
            break
        ranges.append(persisted(_refined(spans.join(large, "bucket", "left_anti"), length, q, unit, task_size)))
        more, rest = _cut_further(spans.join(large, "bucket", "left_semi"), length, width, unit)
        ranges.append(more)
        discard(spans, large)
        spans = rest
    out = ranges[0]
    for r in ranges[1:]:
        out = out.union(r)
    found = persisted(_merged(out, tasks))
    discard(*ranges)
    return found


def _merged(ranges: DataFrame, tasks: int) -> DataFrame:
    """ref and its ranges as few and long as can be, by start; other if any of them has it."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(t: pa.Table) -> pa.Table:
        ref, start, stop = (t.column(k).to_numpy() for k in ("ref", "start", "stop"))
        other = t.column("other").to_numpy(zero_copy_only=False)
        order = np.lexsort((start, ref))
        ref, start, stop, other = ref[order], start[order], stop[order], other[order]
        names, begin, own = np.unique(ref, return_index=True, return_inverse=True)
        reach = np.maximum.accumulate(stop + own * (1 << 40)) - own * (1 << 40)
        new = np.ones(len(ref), dtype=bool)
        new[1:] = (ref[1:] != ref[:-1]) | (start[1:] > reach[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ref))[: len(first)] - 1
        values = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(reach[last])], names=["start", "stop"])
        offsets = np.append(np.searchsorted(ref[first], names), len(first)).astype(np.int32)
        return pa.table({"ref": names, "ranges": pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind), "other": np.logical_or.reduceat(other, begin) if len(ref) else other})

    groups = ranges.groupBy(F.pmod(F.xxhash64("ref"), F.lit(tasks)).alias("_task"))
    return map_groups(ranges.sparkSession, groups, run, "ref bigint, ranges array<struct<start: bigint, stop: bigint>>, other boolean")


def _refined(spans: DataFrame, length: int, q: int, unit, task_size: int) -> DataFrame:
    """Repeated starts of spans in buckets that fit a task; many buckets share one."""

    def run(t: pa.Table) -> pa.Table:
        start, stop, ref = (t.column(k).to_numpy() for k in ("start", "stop", "ref"))
        symbols = [np.frombuffer(x, dtype=unit.kind) for x in t.column("span").to_pylist()]
        hits, others = repeated_starts(symbols, stop - start, np.unique(ref, return_inverse=True)[1], length, q, unit)
        out: list[tuple[int, int, int, bool]] = []
        for r, s, h, o in zip(ref.tolist(), start.tolist(), hits, others, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], h.view(np.int8), [0]])))
            out += [(r, s + a, s + z, bool(o[a:z].any())) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        cols = np.array(out, dtype=np.int64).reshape(-1, 4)
        return pa.table({"ref": cols[:, 0], "start": cols[:, 1], "stop": cols[:, 2], "other": cols[:, 3].astype(bool)})

    tasks = max(1, -(-spans.count() // task_size))
    return map_groups(spans.sparkSession, spans.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(tasks)).alias("_task")), run, _RANGE)


def _cut_further(spans: DataFrame, length: int, width: int, unit) -> tuple[DataFrame, DataFrame]:
    """Pieces of ``width`` offsets: ranges of those found twice as a whole, and spans of the others by the symbols that their strings share."""
    w = unit.kind.itemsize

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("bucket", "ref", "start", "stop", "anchor", "hi", "lo", "span")}
        columns = [batch.column(k).to_pylist() for k in ("bucket", "ref", "start", "stop", "anchor", "span")]
        for bucket, ref, start, stop, anchor, span in zip(*columns, strict=True):
            s = start
            while s < stop:
                # offsets of the anchor from a start: o; pieces end where o passes a multiple of the width
                nth = (anchor - s) // width
                e = min(stop, anchor - nth * width + 1)
                text = span[(s - start) * w : (e - 1 - start + length) * w]
                last, first = anchor - nth * width, anchor - nth * width - width + 1  # starts at the ends of the offset range
                common = span[max(0, last - start) * w : max(0, first - start + length) * w]
                key = hashlib.blake2b(common + f"|{bucket}|{nth}".encode(), digest_size=8).digest()
                name = hashlib.blake2b(text + f"|{anchor - s}|{anchor - e}".encode(), digest_size=16).digest()
                hi, lo = np.frombuffer(name, dtype="<i8").tolist()
                for k, v in zip(out, (int.from_bytes(key, "little", signed=True), ref, s, e, anchor, hi, lo, text), strict=True):
                    out[k].append(v)
                s = e
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "span" else pa.int64()) for k, v in out.items()})

    pieces = persisted(map_arrow(spans, run, _SPAN))
    kinds = persisted(pieces.groupBy("bucket", "hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "start", "stop", "anchor", "span")).alias("one"), F.max("ref").alias("last_ref")))
    whole = kinds.where("n > 1").select("bucket", "hi", "lo", (F.col("one.ref") != F.col("last_ref")).alias("other"))
    ranges = persisted(pieces.join(whole, ["bucket", "hi", "lo"]).select("ref", "start", "stop", "other"))
    discard(pieces)
    several = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    rest = persisted(kinds.join(several, "bucket", "left_semi").select("bucket", "one.ref", "one.start", "one.stop", "one.anchor", "hi", "lo", "one.span"))
    discard(kinds)
    return ranges, rest


def remove_repeats(docs: DataFrame, length: int = 400, keep: tuple[str, ...] = ("doc_id",), q: int = 100, words: int = 51, bucket_limit: int = BUCKET) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans, spans (start, end in bytes), ``left``
    (binary: the bytes left, joined) and n_shared_words for each row of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere
    else, in any document or the same; strings don't cross documents and are judged
    on the input. Null text is empty and loses nothing, as does one under ``length``
    bytes. A repeated row is a document of its own, so that it and its copy lose all
    that is long enough. Cuts may fall within a character, hence bytes. Null keys pass.

    n_shared_words tells of passages that are long in words but perhaps not in bytes:
    the words that strings of ``words`` words (A-Z in lower case) cover which also
    start anywhere else, in documents that share one with another document (of another
    doc_id or text), and 0 in others. Nothing is removed for them.
    """
    with shuffles_dropped(docs.sparkSession):
        keyed = named(docs.select(*dict.fromkeys((*keep, "doc_id", "text"))), "ref", "doc_id", "text")
        texts = keyed.select("ref", "text")
        by_bytes = repeated_ranges(texts, length, min(q, length), bucket_limit=bucket_limit)
        by_words = repeated_ranges(texts, words, max(1, words // 6), Words, bucket_limit=bucket_limit).where("other")
    by = by_bytes.select("ref", "ranges").join(by_words.select("ref", F.col("ranges").alias("shared")), "ref", "full").withColumnRenamed("ref", "_ref")
    joined = keyed.join(by, F.col("ref") == F.col("_ref"), "left").select(*dict.fromkeys((*keep, "text")), "ranges", "shared")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in keep] + ["n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, end: bigint>>, left binary, n_shared_words bigint"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def covered(ranges: list[dict] | None, n: int) -> list[list[int]]:
        """What strings of n symbols cover that start in ranges."""
        merged: list[list[int]] = []
        for r in ranges or ():
            a, z = r["start"], r["stop"] - 1 + n
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        return merged

    def run(batch: pa.RecordBatch):
        for block in blocks(batch, limit=BLOCK):
            n_bytes, spans, left, shared = [], [], [], []
            for text, ranges, passages in zip(text_bytes(block), block.column("ranges").to_pylist(), block.column("shared").to_pylist(), strict=True):
                merged = covered(ranges, length)
                kept, at = [], 0
                for a, z in merged:
                    kept.append(text[at:a])
                    at = z
                n_bytes.append(len(text))
                spans.append([{"start": a, "end": z} for a, z in merged])
                left.append(b"".join([*kept, text[at:]]))
                shared.append(sum(z - a for a, z in covered(passages, words)))
            gone = [sum(s["end"] - s["start"] for s in x) for x in spans]
            yield pa.RecordBatch.from_pydict({k: block.column(k) for k in keep} | {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "spans": pa.array(spans, span), "left": pa.array(left, pa.binary()), "n_shared_words": pa.array(shared, pa.int64())})

    return map_arrow(joined, run, ", ".join(fields))


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"), "n_shared_words")
