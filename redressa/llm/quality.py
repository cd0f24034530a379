"""Quality rules: hashed n-gram log-likelihood ratio of trusted text to all text.

Two multinomials over hashed unigrams and bigrams are counted: one over a trusted
set, one over every document. The score of a document is the mean over its n-grams
of ``ln(p_trusted / p_corpus)``, so its length does not matter, and a document is
kept when it passes plain base rules and its score reaches a fixed threshold.
Everything is DataFrame and SQL functions.

Scale: counting is one scan whose map side already ends in at most ``buckets`` rows
a task; the model is ``buckets`` doubles whatever the corpus, so it goes into the
plan as a literal; scores are summed in the scan's tasks, and only their measures are
shuffled, not the text. The one join is with
the trusted ids, a sample of at most ``TRUSTED_SAMPLE`` (a documented bound), which is
what makes it a broadcast.

Defined results: a null or empty text has no words, scores 0 and fails the base rules.
Repeated rows and null ids are scored like any other. With no trusted rows both
multinomials are the same by definition and every score is 0. Column names of the input
other than the two used are never touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import words_of

BUCKETS = 10_000
PRIOR_SHARE = 0.2
TRUSTED_SAMPLE = 20_000
THRESHOLD = -0.14
MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
SYMBOLS = "[#*$%&|<>]"


def _pairs(words: Column) -> Column:
    """Each word with the next one (null after the last)."""
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.arrays_zip(words.alias("word"), following.alias("next"))


def _buckets(pair: Column, buckets: int) -> tuple[Column, Column]:
    """Bucket of the word and, unless it is the last, of the word and its next."""
    word, after = pair["word"], pair["next"]
    return (
        F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int"),
        F.when(after.isNotNull(), F.pmod(F.xxhash64(word, after), F.lit(buckets)).cast("int")),
    )


def trusted_ids(labels: DataFrame, most: int = TRUSTED_SAMPLE) -> DataFrame:
    """``doc_id`` of at most ``most`` rows labelled as good, by smallest hash."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    # A hash threshold first, so that the one task that picks does not get ``most`` rows from every other.
    part = min(1.0, 1.5 * most / max(good.count(), 1))
    below = F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1 << 24)) < int(part * (1 << 24)) + 1
    return good.filter(below).distinct().orderBy(F.xxhash64("doc_id", F.lit("trusted")), "doc_id").limit(most)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior_share: float = PRIOR_SHARE) -> list[float]:
    """``ln(p_trusted / p_corpus)`` of each bucket, counted over all of ``docs``.

    The trusted multinomial is mixed with ``prior_share`` as many n-grams spread like the corpus, so that
    an n-gram that happens not to be in the trusted texts is no verdict by itself. It is a share, not a number, so
    that a text is judged alike in a table and in any number of copies of it.
    """
    marked = docs.select("doc_id", words_of(F.col("text")).alias("word")).join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left"
    )
    pairs = marked.select("good", F.explode(_pairs(F.col("word"))).alias("pair"))
    counts = (
        pairs.select("good", F.explode(F.array(*_buckets(F.col("pair"), buckets))).alias("bucket"))
        .filter("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count("*").alias("n_all"), F.count("good").alias("n_good"))
        .collect()
    )
    everything, good = [0] * buckets, [0] * buckets
    for row in counts:
        everything[row.bucket], good[row.bucket] = row.n_all, row.n_good
    if not any(good):
        return [0.0] * buckets
    n_all, n_good = sum(everything), sum(good)
    prior = prior_share * n_good
    return [
        math.log((g * n_all / a + prior) / (n_good + prior)) if a else 0.0
        for g, a in zip(good, everything, strict=True)
    ]


def _literal(ratios: list[float]) -> Column:
    """One string literal that the optimizer folds to an array."""
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def _sorted_windows(windows: Column) -> Column:
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated_starts(pairs: Column) -> Column:
    """Starts, in order, of the windows that have an equal neighbour in ``pairs``."""

    def equal(one: Column, other: Column) -> Column:
        return F.coalesce(one["h"] == other["h"], F.lit(False))

    repeated = F.filter(
        pairs,
        lambda p, k: equal(p, F.get(pairs, k - 1)) | equal(p, F.get(pairs, k + 1)),
    )
    return F.sort_array(F.transform(repeated, lambda p: p["i"]))


def _covered(starts: Column) -> Column:
    """Words that windows of three from ``starts`` cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")
        ),
    )["n"]


def rule_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with its base measures.

    Adds ``words`` (the word list), ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines`` and ``n_repeat_words``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns(
        {
            "words": words_of(F.col("text")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "lines": lines,
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "windows": F.transform(
                F.slice("words", 3, F.greatest(F.size("words") - 2, F.lit(0))),
                lambda w, i: F.xxhash64(F.get("words", i), F.get("words", i + 1), w),
            ),
        }
    ).drop("lines")
    # Most texts repeat no window, which the distinct count shows; only the others
    # sort their windows to bring equal ones side by side. Each step is its own
    # projection, so that none of them is worked out twice.
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    df = df.withColumn("windows", F.when(repeats, _sorted_windows(F.col("windows"))))
    df = df.withColumn(
        "windows", F.when(F.col("windows").isNotNull(), _repeated_starts(F.col("windows")))
    )
    return df.withColumn(
        "n_repeat_words", F.coalesce(_covered(F.col("windows")), F.lit(0)).cast("long")
    ).drop("windows")


def score(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Measures, ``score``, ``base_failed`` and ``kept`` of each row of ``docs``.

    Returns ``doc_id`` and ``text_hash`` of the row with them, not its text. The n-grams
    of a row are added up where they are made; a number of the row, not the doc_id,
    groups them, so repeated rows and null ids stay apart.
    """
    df = rule_columns(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    df = df.withColumn("text_hash", F.xxhash64("text")).drop("text")
    kept = [c for c in df.columns if c not in ("words", "row")]
    exploded = df.select(*kept, "row", F.explode_outer(_pairs(F.col("words"))).alias("pair"))
    table = _literal(ratios)
    one, two = _buckets(F.col("pair"), len(ratios))
    summed = (
        exploded.select(
            *kept, "row", (F.get(table, one) + F.coalesce(F.get(table, two), F.lit(0.0))).alias("ratio")
        )
        .groupBy("row")
        .agg(*[F.first(c).alias(c) for c in kept], F.sum("ratio").alias("total"))
        .drop("row")
    )
    mean = F.coalesce(F.col("total") / F.greatest(2 * F.col("n_words") - 1, F.lit(1)), F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_SHARE) * F.col("n_words")
    )
    judged = summed.withColumn("score", F.round(mean, 6)).withColumn("base_failed", failed)
    return judged.drop("total").withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold)
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score ``docs`` (``doc_id``, ``text``) against the trusted rows of ``labels``."""
    narrow = docs.select("doc_id", "text")
    return score(narrow, fit(narrow, trusted_ids(labels)), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    Rows with one doc_id and text share a verdict. The rejected keys are the smaller
    side of an anti join, and the optimizer broadcasts them when they are few.
    """
    rejected = (
        quality_rules(docs, labels, threshold)
        .filter(~F.col("kept"))
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .distinct()
    )
    same = docs["doc_id"].eqNullSafe(rejected["_id"]) & (F.xxhash64(docs["text"]) == rejected["_hash"])
    return docs.join(rejected, same, "left_anti")
