"""Byte-level BPE encoding and decoding with the tiktoken library.

The vocabulary comes from a local rank file (one base64 token and its rank a
line), which the driver reads once and broadcasts; a rank file is a fixed
artefact of at most ``MAX_RANK_BYTES``. Long texts are cut beforehand where the
pre-split pattern can't match across, so that the ids are those of the whole
text while no single call has to hold it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, map_arrow, table

#: A rank file is broadcast; anything larger than this isn't one.
MAX_RANK_BYTES = 64 << 20
#: Code points after which the next safe place is taken as a cut.
CHUNK_CHARS = 1 << 16

#: No match of PATTERN holds both sides of these places: a match has white space
#: at its start only or throughout, and letters or digits are never followed by
#: another class. The look-ahead for white space sees the same on either side.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")

_encoders: dict[int, object] = {}


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def encoder(raw: bytes, pattern: str):
    """The encoding of a rank file, made once in a worker."""
    import tiktoken

    key = hash((raw, pattern))
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("skein", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={})
    return _encoders[key]


def safe_chunks(text: str, size: int = CHUNK_CHARS) -> Iterable[str]:
    """Pieces of ``text`` of about ``size`` code points whose encodings, joined, are that of the text.

    A run without a safe place stays whole, however long.
    """
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found or found.start() >= len(text):
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode(enc, text: str) -> np.ndarray:
    parts = [enc.encode_ordinary(piece) for piece in safe_chunks(text)]
    return np.concatenate([np.array(p, dtype="<u4") for p in parts])


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is too large for a rank file")
    return raw


def encode_documents(docs: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """A row for each row of ``docs``: the columns in ``keep``, ``ids`` (array of int) and ``n_tokens``; a map, without a shuffle.

    ``digests`` adds ``ids_sha256`` (ids as little-endian unsigned 32-bit integers)
    and ``decoded_sha256`` (of the bytes that the ids stand for). A null text is
    empty and has no ids. Repeated rows, ties and null keys pass through; other
    columns are ignored. The text column is named ``text``.
    """
    spark: SparkSession = docs.sparkSession
    raw = spark.sparkContext.broadcast(read_ranks(rank_file))
    source = docs.select(*dict.fromkeys((*keep, "text")))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    fields += ["ids array<int>"] * ids + ["n_tokens bigint"] + ["ids_sha256 string", "decoded_sha256 string"] * digests

    def run(batch: pa.RecordBatch):
        enc = encoder(raw.value, pattern)
        for block in blocks(batch):
            rows = [encode(enc, t or "") for t in block.column("text").to_pylist()]
            out = {k: block.column(k) for k in keep}
            if ids:
                out["ids"] = pa.array([r.astype(np.int32) for r in rows], type=pa.list_(pa.int32()))
            out["n_tokens"] = pa.array([len(r) for r in rows], type=pa.int64())
            if digests:
                out["ids_sha256"] = pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows], type=pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(enc.decode_bytes(r.tolist())).hexdigest() for r in rows], type=pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return map_arrow(source, run, ", ".join(fields))


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The inverse: ``keep`` and ``bytes`` (binary) for each row with ``ids``.

    Ids may end within a character, so that the result is bytes and not text.
    Null ids give no bytes; an id outside the vocabulary is an error.
    """
    raw = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    source = encoded.select(*keep, "ids")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in keep] + ["bytes binary"]

    def run(batch: pa.RecordBatch):
        enc = encoder(raw.value, pattern)
        out = {k: batch.column(k) for k in keep}
        out["bytes"] = pa.array([enc.decode_bytes(x or []) for x in batch.column("ids").to_pylist()], type=pa.binary())
        return pa.RecordBatch.from_pydict(out)

    return map_arrow(source, run, ", ".join(fields))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=False, digests=True)
