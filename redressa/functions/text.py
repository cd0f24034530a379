"""Measures of one text, as JVM column expressions.

Byte lengths are used wherever the counted text is ASCII: a UTF-8 string knows
its byte length, while counting characters walks the string.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from redressa.functions import batches
from redressa.functions.lexicons import CONNECTIVES, LEXICONS

# Patterns that define the measures. Digits are Unicode digits.
WORD_PATTERN = r"[A-Za-z]+(?:'[A-Za-z]+)?|\p{Nd}+(?:\.\p{Nd}+)?"
SENTENCE_END_PATTERN = r"[.!?]+"
MONEY_PATTERN = r"\{\$[0-9,]+(?:\.[0-9]+)?\}|\$[0-9,]+"
REDACTION_PATTERN = r"(?<![\p{L}\p{N}_])X{2,}(?![\p{L}\p{N}_])"
TOPIC_WORD_PATTERN = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"
# The first character of a line that is not blank.
PARAGRAPH_PATTERN = r"(?:^|[\r\n])[ \t]*+[^ \t\r\n]"

# Every character that counts as blank at the ends of a text.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

SHAPE_MEASURES = (
    "n_chars",
    "n_words",
    "n_sentences",
    "avg_word_len",
    "avg_sentence_len",
    "lexical_diversity",
)
CHARACTER_MEASURES = (
    "uppercase_ratio",
    "digit_count",
    "money_amount_count",
    "redaction_count",
    "question_count",
    "exclamation_count",
)
TEXT_MEASURES = SHAPE_MEASURES + CHARACTER_MEASURES + tuple(LEXICONS)
# Order of the narrative, for the expression index; no model input.
STRUCTURE_MEASURES = ("connective_count", "n_paragraphs")
_RATIOS = ("avg_word_len", "avg_sentence_len", "lexical_diversity", "uppercase_ratio")


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def tokens(lowered: Column) -> Column:
    """Words and numbers of an already lower-cased text."""
    return F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0))


def topic_words(lowered: Column) -> Column:
    """Free-standing ASCII words of three letters or more, lower-cased text."""
    return F.regexp_extract_all(lowered, F.lit(TOPIC_WORD_PATTERN), F.lit(0))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_ascii_removed(text: Column, pattern: str) -> Column:
    """Number of ASCII characters matched by ``pattern``."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))


def count_terms(lowered: Column, terms: Iterable[str]) -> Column:
    """Substring hits, without overlap within a term, summed over the terms.

    Most texts lack most terms, and to look for a term takes half the time of replacing it.
    """
    total = F.lit(0)
    for term in terms:
        without = F.replace(lowered, F.lit(term), F.lit(""))
        lost = F.octet_length(lowered) - F.octet_length(without)
        hits = (lost / F.lit(len(term.encode()))).cast("int")
        total = total + F.when(F.contains(lowered, F.lit(term)), hits).otherwise(0)
    return total


def _is_plain(word: Column) -> Column:
    """Whether a word of a lower-cased text is letters alone: it begins with one and has no apostrophe."""
    return (word >= "a") & (word < "{") & ~F.contains(word, F.lit("'"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def with_text_measures(
    df: DataFrame,
    text: str = "consumer_narrative",
    lexicons: Mapping[str, Iterable[str]] = LEXICONS,
    batched: bool = False,
) -> DataFrame:
    """Append the shape, character, lexicon and structure measures of column ``text``.

    The lower-cased text and its words are computed once in narrow steps of
    their own; unused measures are pruned by the optimizer. Callers that need most of them may ask for
    ``batched`` ones: all are then made on arrays of many texts (:mod:`batches`), with the same values.
    """
    kept = df.columns
    if batched:
        names = (*SHAPE_MEASURES, *CHARACTER_MEASURES, *lexicons, *STRUCTURE_MEASURES)
        kinds = {n: pa.float64() if n in _RATIOS else pa.int32() for n in names}
        schema = ", ".join(f"{n}: {'double' if n in _RATIOS else 'int'}" for n in names)
        measure = F.arrow_udf(batches.measures(kinds, lexicons, CONNECTIVES), f"struct<{schema}>", ArrowUDFType.SCALAR)
        found = df.withColumn("_measures", measure(F.coalesce(F.col(text), F.lit(""))))
        return found.select(*kept, *[F.col("_measures")[n].alias(n) for n in names])
    raw, low, words, plain = F.col("_raw"), F.col("_low"), F.col("_words"), F.col("_plain")
    staged = (
        df.withColumn("_raw", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_low", F.lower(raw))
        .withColumn("_words", tokens(low))
        .withColumn("_plain", F.filter(words, _is_plain))
        .withColumn("_n_words", F.size(words))
        .withColumn(
            "_n_sentences",
            F.when(raw == "", F.lit(0)).otherwise(
                F.greatest(F.lit(1), count_matches(raw, SENTENCE_END_PATTERN))
            ),
        )
    )
    n_words, n_sentences = F.col("_n_words"), F.col("_n_sentences")
    measures = {
        "n_chars": F.length(raw),
        "n_words": n_words,
        "n_sentences": n_sentences,
        "avg_word_len": _ratio(F.octet_length(F.array_join(plain, "")), F.size(plain)),
        "avg_sentence_len": _ratio(n_words, n_sentences),
        "lexical_diversity": _ratio(F.size(F.array_distinct(words)), n_words),
        "uppercase_ratio": _ratio(
            count_ascii_removed(raw, "[A-Z]+"), count_ascii_removed(raw, "[A-Za-z]+")
        ),
        "digit_count": F.length(F.regexp_replace(raw, r"\P{Nd}+", "")),
        # No match without these texts, which are found sooner.
        "money_amount_count": F.when(F.contains(raw, F.lit("$")), count_matches(raw, MONEY_PATTERN)).otherwise(0),
        "redaction_count": F.when(F.contains(raw, F.lit("XX")), count_matches(raw, REDACTION_PATTERN)).otherwise(0),
        "question_count": count_terms(raw, ["?"]),
        "exclamation_count": count_terms(raw, ["!"]),
    }
    for name, terms in lexicons.items():
        measures[name] = count_terms(low, terms)
    measures["connective_count"] = F.size(F.filter(words, lambda w: w.isin(*CONNECTIVES)))
    measures["n_paragraphs"] = count_matches(raw, PARAGRAPH_PATTERN)
    return staged.select(*kept, *[c.alias(n) for n, c in measures.items()])


def normalize_text(text: Column) -> Column:
    """Lower case, dates and amounts masked, runs of blanks reduced to one."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(
        out, r"[0-9x]{1,4}/[0-9x]{1,2}/[0-9x]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>"
    )
    out = F.regexp_replace(out, r"\{\$[0-9,]+(\.[0-9]+)?\}|\$[0-9,]+(\.[0-9]+)?", "<amount>")
    out = F.regexp_replace(out, f"[{BLANKS}]+", " ")
    return strip_blanks(out)
