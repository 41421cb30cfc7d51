"""A corpus pipeline of five text operators over ``documents``.

Each stage takes all rows that the one before kept, with all their columns, and but
for the last returns the same columns; columns with the names of an operator's own
results come back as they were. Null, blank, very long and repeated texts, null ids
and empty tables pass through every stage; what becomes of them is said below.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bpe import encode_documents
from skein.llm.common import discard, persisted, table
from skein.llm.decontaminate import find_leaks
from skein.llm.jaccard import keep_one_of_each
from skein.llm.lines import drop_frequent_lines
from skein.llm.quality import RESULTS, judge


def _with_own_columns(docs: DataFrame, names: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step``, which carries columns along but makes some of the given names, with the columns of ``docs`` as they were."""
    aside = {c: f"__skein_user_{c}" for c in docs.columns if c in names}
    out = step(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or a certified cutoff reject.

    Null, empty and blank texts have no words and go; a repeated row is judged like
    its first. Without labels only the base rules reject.
    """
    return _with_own_columns(docs, RESULTS, lambda d: judge(d, table(spark, sf_dir, "labels")).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more hold; n_chars, where there is one, follows the text.

    Rows are documents, repeated ones too. A null text stays null; a text may become
    empty, and its row stays.
    """

    def step(d: DataFrame) -> DataFrame:
        out = drop_frequent_lines(d, min_docs=10)
        if "n_chars" in d.columns:
            out = out.withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType))
        return out

    return _with_own_columns(docs, ("n_lines", "n_dropped"), step)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: that of the smallest doc_id, null the last.

    Of repeated rows one stays. Texts without words have no class, and all stay.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; null and empty texts hold none and stay."""
    found = "__skein_leaks"
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), name=found).where(F.size(found) == 0).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of the ids and of the bytes that they decode to, with doc_id, lang and source where there are such columns.

    A null text is empty and has no ids; repeated rows are encoded alike.
    """
    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=keep, digests=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the calibrated cutoffs' exact binomial test nor byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written and read again, and goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, persisted(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
