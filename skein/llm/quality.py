"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules are fixed. Beyond them a document has five signals of poor text; for
each there is a ladder of cutoffs from lenient to strict, and a document's
*rung* is the first at which any of its signals is over the cutoff. Rejecting at
rung r rejects all that a lower rung rejects, so that the share of good
documents lost can only grow along the ladder. For each stratum (language), the
labelled good documents that pass the base rules test, rung by rung, whether
that share is at most ``ALPHA``: the hypothesis that it is larger is rejected by
the exact binomial test at ``DELTA`` divided by the number of strata (Bonferroni);
within a stratum the first failure ends the sequence (fixed-sequence testing), so
that all certified rungs hold at once with probability ``1 - DELTA``. Of the
certified rungs, the most lenient of those that reject the most labelled poor
documents is taken. A stratum without enough labels rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persisted, table

#: Largest share of good documents that a stratum may lose, and the chance that any stratum's bound fails.
ALPHA, DELTA = 0.02, 0.05
#: Strata whose cutoffs are broadcast.
MAX_STRATA = 100_000
#: Columns that ``judge`` adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rung", "cutoff_rung", "kept")
#: Words of the windows in which repeats are sought, and of those in which distinct words are counted.
WINDOW, SAME_WINDOW = 8, 50
#: Cutoffs from lenient to strict.
LADDERS: dict[str, tuple[float, ...]] = {
    "symbol_rate": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05),  # symbols a word
    "bang_rate": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.22, 0.16, 0.12, 0.08, 0.05, 0.03),  # exclamation marks a word
    "dup_line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.42, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),  # repeated lines of all lines with words
    "repeat_rate": (0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08),  # words in repeated windows
    "sameness": (0.95, 0.9, 0.85, 0.75, 0.65, 0.55, 0.48, 0.42, 0.39, 0.36, 0.33, 0.3),  # words that occurred before in their window
}
RUNGS = len(LADDERS["symbol_rate"])
_SPACE = " \\t\\n\\u000B\\u000C\\r"


def with_signals(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and rung.

    Words are compared by 64-bit hashes, within a text only.
    """
    kept = docs.columns if keep is None else keep
    t = "coalesce(__skein_q_text, '')"
    out = docs.withColumn("__skein_q_text", F.col("text"))
    out = out.withColumn("__skein_q_words", F.expr(rf"filter(split({t}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"))
    out = out.withColumn("__skein_q_lines", F.expr(rf"filter(split({t}, '\n'), l -> trim(BOTH '{_SPACE}' FROM l) <> '')"))
    out = out.withColumn("__skein_q_w", F.expr("transform(__skein_q_words, w -> xxhash64(w))"))
    out = out.withColumn("__skein_q_h", F.expr(f"if(size(__skein_q_w) >= {WINDOW}, transform(sequence(1, size(__skein_q_w) - {WINDOW - 1}), i -> xxhash64(slice(__skein_q_w, i, {WINDOW}))), cast(array() as array<bigint>))"))
    out = out.withColumn("__skein_q_dup", F.expr("size(array_distinct(__skein_q_h)) < size(__skein_q_h)"))
    out = out.withColumn("__skein_q_s", F.expr("if(__skein_q_dup, sort_array(transform(__skein_q_h, (h, i) -> struct(h as h, i as i))), cast(array() as array<struct<h: bigint, i: int>>))"))
    out = out.withColumn("__skein_q_at", F.expr("sort_array(transform(filter(__skein_q_s, (x, j) -> (j > 0 and __skein_q_s[j - 1].h = x.h) or (j < size(__skein_q_s) - 1 and __skein_q_s[j + 1].h = x.h)), x -> x.i))"))
    n_lines = F.size("__skein_q_lines")
    out = out.select(
        *kept,
        F.size("__skein_q_words").cast("bigint").alias("n_words"),
        F.expr("cast(length(array_join(__skein_q_words, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(regexp_count({t}, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("__skein_q_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(f"aggregate(__skein_q_at, struct(0L as n, -{WINDOW} as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n)").alias("n_repeat_words"),
        n_lines.alias("__skein_q_n_lines"),
        F.expr(f"octet_length({t}) - octet_length(replace({t}, '!', ''))").alias("__skein_q_bang"),
        F.expr(f"aggregate(sequence(0, greatest(size(__skein_q_w) - 1, 0) div {SAME_WINDOW}), 0, (a, i) -> a + size(array_distinct(slice(__skein_q_w, cast(i as int) * {SAME_WINDOW} + 1, {SAME_WINDOW}))))").alias("__skein_q_distinct"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    signals = {
        "symbol_rate": F.col("n_symbols") / n,
        "bang_rate": F.col("__skein_q_bang") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("__skein_q_n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / n,
        "sameness": (F.col("n_words") - F.col("__skein_q_distinct")) / n,
    }
    out = out.withColumns({f"__skein_q_{k}": v for k, v in signals.items()})
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.withColumn("rung", F.least(*[_rung(F.col(f"__skein_q_{k}"), c) for k, c in LADDERS.items()])).select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rung")


def _rung(signal: Column, cutoffs: tuple[float, ...]) -> Column:
    """1 to RUNGS: the first cutoff that the signal is over; RUNGS + 1: none."""
    over = sum((F.when(signal > c, 1).otherwise(0) for c in cutoffs), F.lit(0))
    return F.lit(RUNGS + 1) - over


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exact up to rounding; sums in logarithms, so that no n underflows."""
    step = f"ln(greatest({n} - i, 1)) - ln(i + 1) + ln({p}) - ln(1 - {p})"
    total = "greatest(a.s, a.t + {d}) + log1p(exp(-abs(a.s - a.t - {d})))"
    d = f"({step})"
    return F.expr(
        f"least(1d, exp(aggregate(sequence(0, greatest(cast({k} as int) - 1, 0)), struct(cast({n} * ln(1 - {p}) as double) as t, cast({n} * ln(1 - {p}) as double) as s),"
        f" (a, i) -> if(i >= {k}, a, struct(cast(a.t + {d} as double) as t, cast({total.format(d=d)} as double) as s)), a -> a.s)))"
    )


def certified_rungs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoff_rung (0: reject nothing) from rows of stratum, rung and good (boolean).

    Each label is counted into a stratum's rung before anything is shuffled. Of the
    strata only their number comes to the driver.
    """
    counts = persisted(labelled.groupBy("stratum", "rung").agg(F.sum(F.col("good").cast("bigint")).alias("good"), F.sum((~F.col("good")).cast("bigint")).alias("poor")))
    strata = max(1, counts.select("stratum").distinct().count())
    # a ladder has a dozen rungs, so that a stratum's group is at most that long
    per = counts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rung", F.struct("good", "poor")))).alias("m"))
    rows = per.withColumn("n", F.expr("aggregate(map_values(m), 0L, (a, x) -> a + x.good)"))
    rows = rows.select("stratum", "n", F.expr(f"explode(sequence(1, {RUNGS}))").alias("rung"), "m")
    below = "aggregate(map_entries(m), 0L, (a, e) -> a + if(e.key <= rung, e.value.{x}, 0L))"
    rows = rows.select("stratum", "n", "rung", F.expr(below.format(x="good")).alias("lost"), F.expr(below.format(x="poor")).alias("caught"))
    rows = rows.withColumn("ok", (F.col("n") > 0) & (F.col("lost") <= alpha * F.col("n")))
    rows = rows.withColumn("ok", F.when(F.col("ok"), binomial_tail("lost", "n", alpha) <= F.lit(delta / strata)).otherwise(F.lit(False)))
    ladder = rows.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("rung", "ok", "caught"))).alias("l"))
    ladder = ladder.withColumn("held", F.expr(f"filter(l, x -> x.rung < coalesce(get(filter(l, y -> not y.ok), 0).rung, {RUNGS + 1}))"))
    best = F.expr("coalesce(get(filter(held, x -> x.caught = array_max(transform(held, y -> y.caught)) and x.caught > 0), 0).rung, 0)")
    return ladder.select("stratum", best.alias("cutoff_rung"))


def stratum_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang"), F.lit("und")) if "lang" in docs.columns else F.lit("und")


def trials(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, rung and good: a row for each labelled document, and for each text of a stratum, that passes the base rules.

    ``judged`` has doc_id, stratum, text_hash, rung and base_failed. Rows of one
    doc_id are one trial, by their least rung; so are documents of one text, which
    is good if all of its labels are.
    """
    said = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    rows = judged.where(~F.col("base_failed")).join(said, "doc_id").groupBy("doc_id").agg(F.min(F.struct("rung", "stratum", "text_hash")).alias("one"), F.min("good").alias("good"))
    once = rows.groupBy("one.stratum", "one.text_hash").agg(F.min("one.rung").alias("rung"), F.min("good").alias("good"))
    return once.select("stratum", "rung", "good")


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the base columns,
    ``base_failed``, ``rung``, ``cutoff_rung`` and ``kept``.

    ``docs`` has doc_id, text and perhaps lang, the stratum; ``labels`` has doc_id
    and quality (1 good, 0 poor; null or a null doc_id is no label; of several for a
    document the lowest counts). A null text has no words and fails the base rules,
    as an empty one does. A null language is the stratum ``und``. Repeated rows are
    judged alike. With no labels only base rules reject. A column of ``docs`` with
    the name of a result column is replaced.

    The binomial bound needs trials that don't depend on each other. Rows that
    repeat a labelled document, and labelled documents of one text, are therefore
    one trial. Near copies aren't recognised here: labels should be of documents
    drawn at random, or after near-duplicate removal, or the bound is only as good
    as the number of really different documents among them.

    The text is read once: rows with their signals are written to the shared store,
    and calibration and verdicts read from there. Counts for each stratum and rung
    are all that the labels leave; they join back as a row for each stratum.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    staged = docs.drop(*RESULTS).withColumn("__skein_q_stratum", stratum_of(docs)).withColumn("__skein_q_hash", F.xxhash64("text"))
    scored = persisted(with_signals(staged, [*dict.fromkeys([*keep, "doc_id", "__skein_q_stratum", "__skein_q_hash"])]))
    judged = scored.select("doc_id", F.col("__skein_q_stratum").alias("stratum"), F.col("__skein_q_hash").alias("text_hash"), "rung", "base_failed")
    cutoffs = persisted(certified_rungs(trials(judged, labels), alpha, delta).withColumnRenamed("stratum", "__skein_q_stratum"))
    if cutoffs.count() <= MAX_STRATA:  # else they are joined by a shuffle
        cutoffs = F.broadcast(cutoffs)
    out = scored.join(cutoffs, "__skein_q_stratum", "left").withColumn("cutoff_rung", F.coalesce("cutoff_rung", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rung") > F.col("cutoff_rung"))).select(*keep, *RESULTS)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
