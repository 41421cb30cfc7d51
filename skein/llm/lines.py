"""Line deduplication with two Bloom filters.

A task keeps one record of each distinct key of its lines: how many of its documents
have it, and the first place. Records go once, about 40 bytes each, to the range of
hashes that theirs falls into. There, one filter holds the hashes seen once and one
those seen twice; of the records, only suspects, whose hash is in the second filter,
shuffle on to the exact count of documents and the first occurrence. Lines that
nobody else has end at the filters. A last pass over the texts drops lines.

Filters are cut by range because one for all lines of a large corpus fits neither a
broadcast nor a task; a range has about ``RANGE_LINES`` lines whatever the corpus'
size, so that filters never fill up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, map_batches, map_groups, persisted, table, text_bytes

#: Lines of a range of hashes, about, and bits of each of its filters.
RANGE_LINES, FILTER_BITS = 1 << 20, 1 << 23
#: Records that a range puts into its filters at once, and keys that a task gathers.
AT_ONCE, GATHER = 1 << 17, 300_000
#: Frequent keys that are broadcast, as a table of 16 bytes each and their first place; more are joined instead.
MAX_BROADCAST_KEYS = 200_000
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower is that of ASCII


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


def _digests(keys: list[bytes]) -> np.ndarray:
    """Two signed 64-bit halves of the 128-bit hash of each key."""
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(raw, dtype=">i8").astype(np.int64).reshape(-1, 2)


def _listed(texts: list[bytes], min_length: int) -> tuple[list[int], list[int], list[bytes]]:
    """Text, line and key of all lines that have one."""
    of, line, keys = [], [], []
    for d, text in enumerate(texts):
        for i, k in enumerate(map(line_key, text.split(b"\n"))):
            if _long(k, min_length):
                of.append(d)
                line.append(i)
                keys.append(k)
    return of, line, keys


def _places(hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = hi.view(np.uint64)
    return (u & np.uint64(bits - 1)).astype(np.int64), ((u >> np.uint64(33)) & np.uint64(bits - 1)).astype(np.int64)


def suspects(hi: np.ndarray, n: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Which records (hash, documents) may share their hash with another or count twice themselves: a superset of those."""
    once, twice = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)

    def put(h: np.ndarray, n: np.ndarray) -> None:
        a, b = _places(h, bits)
        again = (once[a] & once[b]) | (n > 1)
        twice[a[again]] = twice[b[again]] = True
        once[a] = once[b] = True

    for at in range(0, len(hi), AT_ONCE):
        h, k = hi[at : at + AT_ONCE], n[at : at + AT_ONCE]
        first = np.zeros(len(h), dtype=bool)
        first[np.unique(h, return_index=True)[1]] = True
        put(h[first], k[first])
        put(h[~first], k[~first])
    a, b = _places(hi, bits)
    return twice[a] & twice[b]


def key_records(docs: DataFrame, ranges: int, min_length: int) -> DataFrame:
    """range, hi, lo (the key's hash), n (documents of the task that have it), and doc_id, line of its first place, for each key of a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        half, ids, at, line, size, before = [], [], [], [], 0, 0

        def flush():
            h, doc, where = np.concatenate(half), np.concatenate(at), np.concatenate(line)
            own = pa.concat_arrays(ids)
            rank = np.asarray(pc.rank(own, null_placement="at_start", tiebreaker="dense"))
            order = np.lexsort((where, rank[doc], h[:, 1], h[:, 0]))
            h, doc, where = h[order], doc[order], where[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]).any(axis=1)
            start = np.flatnonzero(new)
            h = h[start]
            of = (h[:, 1].view(np.uint64) % np.uint64(ranges)).astype(np.int64)
            n = np.diff(np.append(start, len(new)))
            return pa.RecordBatch.from_pydict({"range": pa.array(of), "hi": pa.array(h[:, 0]), "lo": pa.array(h[:, 1]), "n": pa.array(n), "doc_id": own.take(pa.array(doc[start])), "line": pa.array(where[start])})

        for batch in batches:
            for block in blocks(batch):
                doc, places, keys = [], [], []
                for d, text in enumerate(text_bytes(block), before):
                    found: dict[bytes, int] = {}
                    for i, k in enumerate(map(line_key, text.split(b"\n"))):
                        if _long(k, min_length):
                            found.setdefault(k, i)
                    doc += [d] * len(found)
                    places += found.values()
                    keys += found
                half.append(_digests(keys))
                ids.append(block.column("doc_id"))
                at.append(np.array(doc, dtype=np.int64))
                line.append(np.array(places, dtype=np.int64))
                before += block.num_rows
                size += len(keys)
                if size >= GATHER:
                    yield flush()
                    half, ids, at, line, size, before = [], [], [], [], 0, 0
        if size:
            yield flush()

    return map_batches(docs.select("doc_id", "text"), run, f"range bigint, hi bigint, lo bigint, n bigint, doc_id {kind}, line bigint")


def frequent_lines(docs: DataFrame, min_docs: int, min_length: int = 1) -> DataFrame:
    """hi, lo (the key's hash), n_docs, and first_doc, first_line of the keys in ``min_docs`` documents or more (2 at least)."""
    if min_docs < 2:
        raise ValueError("min_docs is 2 or more")
    lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    records = key_records(docs, max(1, -(-int(lines) // RANGE_LINES)), max(1, min_length))

    def picked(t: pa.Table) -> pa.Table:
        return t.filter(pa.array(suspects(t.column("hi").to_numpy(), t.column("n").to_numpy()))).drop_columns(["range"])

    seen = map_groups(docs.sparkSession, records.groupBy("range"), picked, f"hi bigint, lo bigint, n bigint, doc_id {kind}, line bigint")
    found = seen.groupBy("hi", "lo").agg(F.sum("n").alias("n_docs"), F.min(F.struct("doc_id", "line")).alias("first")).where(F.col("n_docs") >= min_docs)
    return found.select("hi", "lo", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, keep_first: bool = False, broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` documents or more.

    A key is the line without ASCII white space at its ends, A-Z in lower case;
    keys under ``min_length`` code points (1 at least) are left alone. ``text``
    becomes the lines left, joined by \\n; ``n_lines`` (before) and ``n_dropped`` are
    added and replace columns of those names. Null or empty text is one empty line,
    stays as it is (null: null) and loses nothing. With ``keep_first`` the occurrence
    of least (doc_id, line) stays, nulls first. Rows are documents: a repeated row
    counts as one more document. doc_id has any type that has an order. All other
    columns are carried; the row order isn't kept.
    """
    docs = docs.drop("n_lines", "n_dropped")
    spark: SparkSession = docs.sparkSession
    least = max(1, min_length)
    frequent = frequent_lines(docs, min_docs, min_length)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_lines bigint", "n_dropped bigint"]
    rows = frequent.limit(broadcast_keys + 1).collect()
    if len(rows) > broadcast_keys:
        return _drop_joined(docs, persisted(frequent), least, keep_first, columns)
    rows = sorted(rows, key=lambda r: (r.hi, r.lo))
    hashes = np.array([(r.hi, r.lo) for r in rows], dtype=np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((hashes, [(r.first_doc, r.first_line) for r in rows] if keep_first else []))

    def run(batch: pa.RecordBatch):
        known, first = shared.value
        for block in blocks(batch):
            texts = text_bytes(block)
            of, line, keys = _listed(texts, least)
            drops: list[set[int]] = [set() for _ in texts]
            ids = block.column("doc_id").to_pylist() if keep_first else []
            for i, j in _met(known, _digests(keys)):
                if not (keep_first and first[j] == (ids[of[i]], line[i])):
                    drops[of[i]].add(line[i])
            yield _rewritten(block, texts, drops)

    return map_arrow(docs, run, ", ".join(columns))


def _met(known: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Places in ``own`` of hashes that are among ``known`` (sorted), and their places there."""
    if not len(known) or not len(own):
        return []
    out = []
    at = np.searchsorted(known[:, 0], own[:, 0])
    for i in np.flatnonzero(known[np.minimum(at, len(known) - 1), 0] == own[:, 0]).tolist():
        j = int(at[i])
        while j < len(known) and known[j, 0] == own[i, 0]:
            if known[j, 1] == own[i, 1]:
                out.append((i, j))
                break
            j += 1
    return out


def _rewritten(block: pa.RecordBatch, texts: list[bytes], drops: list[set[int]]) -> pa.RecordBatch:
    n_lines, n_dropped, out = [], [], []
    for text, drop, whole in zip(texts, drops, block.column("text"), strict=True):
        lines = text.split(b"\n")
        n_lines.append(len(lines))
        n_dropped.append(len(drop))
        out.append((b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text).decode() if whole.is_valid else None)
    columns = {f.name: block.column(i) for i, f in enumerate(block.schema)} | {"text": pa.array(out, type=pa.string())}
    return pa.RecordBatch.from_pydict(columns | {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})


def _drop_joined(docs: DataFrame, frequent: DataFrame, min_length: int, keep_first: bool, columns: list[str]) -> DataFrame:
    """The same where the frequent keys are too many to broadcast: lines meet them in a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def listed(batch: pa.RecordBatch):
        for block in blocks(batch):
            of, line, keys = _listed(text_bytes(block), min_length)
            half, of = _digests(keys), pa.array(of, pa.int64())
            yield pa.RecordBatch.from_pydict({"__skein_d": block.column("doc_id").take(of), "__skein_h": block.column("__skein_h").take(of), "line": pa.array(line, pa.int64()), "hi": pa.array(half[:, 0]), "lo": pa.array(half[:, 1])})

    keyed = docs.withColumn("__skein_h", F.xxhash64("text"))
    lines = map_arrow(keyed.select("doc_id", "text", "__skein_h").dropDuplicates(["doc_id", "__skein_h"]), listed, f"__skein_d {kind}, __skein_h bigint, line bigint, hi bigint, lo bigint")
    hit = lines.join(frequent, ["hi", "lo"])
    if keep_first:
        hit = hit.where(~(F.col("__skein_d").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line"))))
    drops = hit.groupBy("__skein_d", "__skein_h").agg(F.collect_set("line").alias("__skein_drop")).withColumnsRenamed({"__skein_d": "__skein_d2", "__skein_h": "__skein_h2"})
    joined = keyed.join(drops, F.col("doc_id").eqNullSafe(F.col("__skein_d2")) & (F.col("__skein_h") == F.col("__skein_h2")), "left").select(*docs.columns, "__skein_drop")

    def run(batch: pa.RecordBatch):
        for block in blocks(batch):
            drops = [set(x or ()) for x in block.column("__skein_drop").to_pylist()]
            yield _rewritten(block.drop_columns(["__skein_drop"]), text_bytes(block), drops)

    return map_arrow(joined, run, ", ".join(columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_KEYED = "select r, doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from (select r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from (select row_number() over () as r, doc_id, text from documents))"
OP5_SQL = f"""
with k as ({_KEYED}), bad as (select k from k where k <> '' group by k having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where k in (select k from bad)) as n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (where k not in (select k from bad)), '')) as kept_sha256
from k group by r, doc_id
"""
