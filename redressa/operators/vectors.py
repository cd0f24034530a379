"""Terms, vocabularies and TF-IDF vectors of narratives.

A document is one row all the way: words, word pairs, counts and weights are
made within the row, so only vocabulary counts are ever shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from redressa.functions import batches
from redressa.functions.lexicons import DOMAIN_STOP_WORDS, ENGLISH_STOP_WORDS
from redressa.functions.text import topic_words
from redressa.session import discard, materialize

# Words whose pairs are counted by number: so many travel with each task at most.
NUMBERED = 40_000

# Workers need not have this package installed: its code travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def default_stop_words() -> list[str]:
    """English and domain words."""
    return sorted({*ENGLISH_STOP_WORDS, *DOMAIN_STOP_WORDS})


def with_topic_words(
    df: DataFrame, text: str = "consumer_narrative", output: str = "words"
) -> DataFrame:
    return df.withColumn(output, topic_words(F.lower(F.coalesce(F.col(text), F.lit("")))))


def drop_stop_words(
    df: DataFrame, stop_words: Sequence[str], column: str = "words", output: str = "kept_words"
) -> DataFrame:
    remover = StopWordsRemover(
        inputCol=column, outputCol=output, stopWords=list(stop_words), caseSensitive=True
    )
    return remover.transform(df)


def with_terms(df: DataFrame, words: str = "kept_words", output: str = "terms") -> DataFrame:
    """Single words and pairs of neighbouring words."""
    pairs = NGram(n=2, inputCol=words, outputCol="_pairs").transform(df)
    return pairs.withColumn(output, F.concat(words, "_pairs")).drop("_pairs")


def narrative_words(
    df: DataFrame, text: str = "consumer_narrative", stop_words: Sequence[str] | None = None, batched: bool = False
) -> DataFrame:
    """Append ``kept_words``: the words of column ``text`` without stop words.

    This is the form to write when several passes follow: word pairs triple
    its size, and each pass makes them again within the row. ``batched`` words are found in arrays
    of many texts (:mod:`batches`); they are the same.
    """
    if batched:
        found = batches.topic_words(stop_words or default_stop_words())
        return df.withColumn("kept_words", F.arrow_udf(found, "array<string>", ArrowUDFType.SCALAR)(F.col(text)))
    words = with_topic_words(df, text, "_words")
    return drop_stop_words(words, stop_words or default_stop_words(), "_words").drop("_words")


def term_uses(df: DataFrame, terms: str = "terms", keep: Sequence[str] = ()) -> DataFrame:
    """One row per use of a term and, with ``use`` false, one per document and term: ``keep``, ``term``, ``use``."""
    both = F.concat(terms, F.array_distinct(terms))
    return df.select(*keep, F.size(terms).alias("_uses"), F.posexplode(both).alias("_place", "term")).select(
        *keep, "term", (F.col("_place") < F.col("_uses")).alias("use")
    )


def term_counts(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Occurrences (cf) and documents (df) per term, in one shuffle by term.

    Each document emits its terms and, marked apart, its distinct terms; both
    are summed map-side, so no (document, term) pair is shuffled.
    """
    use = F.col("use")
    return term_uses(df, terms).groupBy("term").agg(
        F.count_if(use).alias("cf"), F.count_if(~use).alias("df")
    )


def _counted(df: DataFrame, words: str, numbered: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """cf and df per word, or per pair of neighbouring ``numbered`` words (``pair``: first number times their count
    plus second number); apart for each value of the string column ``by``, if named.

    Each batch of documents adds up its own words in arrays, so a use costs no row; the batches' sums are
    added up map-side, then in one shuffle.
    """
    of = "pair" if numbered is not None else "term"
    names = pa.array(numbered, pa.string()) if numbered is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows, flat = np.repeat(np.arange(len(lists)), lengths), lists.flatten()
            if names is None:
                found = flat.dictionary_encode()
                codes, labels = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
                width = max(1, len(labels))
            else:
                codes = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                inside = (rows[1:] == rows[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0)
                width = len(names) ** 2
                rows, codes = rows[:-1][inside], (codes[:-1] * len(names) + codes[1:])[inside]
            # Rows of a batch times codes: far below 2^63.
            groups = batch.column("by").dictionary_encode() if by else None
            if groups is not None:
                # Null is a group too, the last one.
                own = groups.indices.fill_null(len(groups.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                own = np.zeros(len(lists), dtype=np.int64)
            keys, cf = np.unique(own[rows] * width + codes, return_counts=True)
            each = np.sort(rows * width + codes)
            each = each[np.r_[True, each[1:] != each[:-1]][: len(each)]]
            # The same keys, in the same order.
            df_counts = np.unique(own[each // width] * width + each % width, return_counts=True)[1]
            code = keys % width
            columns = {of: pa.array(code) if names is not None else labels.take(pa.array(code))}
            columns |= {"cf": pa.array(cf.astype(np.int64)), "df": pa.array(df_counts.astype(np.int64))}
            if groups is not None:
                place = keys // width
                columns["by"] = groups.dictionary.take(pa.array(place, mask=place == len(groups.dictionary)))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"{of} {'string' if names is None else 'long'}, cf long, df long" + (", by string" if by else "")
    picked = df.select(F.col(words).alias("words"), *([F.col(by).alias("by")] if by else []))
    sums = picked.mapInArrow(run, schema)
    return sums.groupBy(*(["by"] if by else []), of).agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _pair_names(pairs: DataFrame, numbered: Sequence[str]) -> DataFrame:
    """``pairs`` with ``term`` in place of ``pair``."""
    n = max(1, len(numbered))
    frame = pairs.sparkSession.createDataFrame(list(enumerate(numbered)), "id long, word string")
    first = F.broadcast(frame.select(F.col("id").alias("_a"), F.col("word").alias("_first")))
    second = F.broadcast(frame.select(F.col("id").alias("_b"), F.col("word").alias("_second")))
    split = pairs.withColumns({"_a": F.expr(f"pair div {n}"), "_b": F.col("pair") % n})
    joined = split.join(first, "_a").join(second, "_b")
    return joined.withColumn("term", F.concat_ws(" ", "_first", "_second")).drop("_a", "_b", "_first", "_second", "pair")


def _leading_counts(df: DataFrame, words: str, min_df: int, max_df: float, size: int) -> DataFrame | None:
    """cf and df of all terms that can be among the ``size`` most used ones within the bounds; None if their words are
    too many to be numbered.

    A pair is used no more often, and in no more documents, than either of its words. The words within the
    bounds alone say how often the last of ``size`` terms is used at least, so pairs with a rarer word are not counted.
    """
    counts = materialize(_counted(df, words), "word-counts")
    n = df.count()
    usable = counts.filter((F.col("df") >= min_df) & (F.col("df") <= n * F.lit(max_df)))
    last = usable.orderBy(F.desc("cf")).limit(size).agg(F.count(F.lit(1)), F.min("cf")).first()
    least = last[1] if last[0] == size and size else 0
    enough = (F.col("cf") >= least) & (F.col("df") >= min_df)
    found = counts.filter(enough).limit(NUMBERED + 1).collect()
    discard(counts)
    if len(found) > NUMBERED:
        return None
    numbered = [r["term"] for r in found]
    pairs = _pair_names(_counted(df, words, numbered).filter(enough), numbered)
    alone = df.sparkSession.createDataFrame([(r["term"], r["cf"], r["df"]) for r in found], "term string, cf long, df long")
    return alone.unionByName(pairs)


def leading_uses(df: DataFrame, by: str, words: str, top: int) -> DataFrame:
    """``by``, ``term`` and ``weight``, its uses there, of all terms that can be among the ``top`` of their group.

    As :func:`fit_vocabulary`, pairs with a word that is rarer than the group's ``top`` words are not counted. ``df`` is read
    twice, so pass a written table; its words have no blanks.
    """
    counts = materialize(_counted(df, words, by=by), "word-uses")
    order = Window.partitionBy("by").orderBy(F.desc("cf"))
    last = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= top)
    last = last.groupBy("by").agg(F.when(F.count(F.lit(1)) == top, F.min("cf")).otherwise(0).alias("_least"))
    last = last.withColumnRenamed("by", "_group")
    enough = counts.join(last, F.col("by").eqNullSafe(F.col("_group")) & (F.col("cf") >= F.col("_least")))
    enough = enough.select("by", "term", "cf")
    found = enough.select("term").distinct().limit(NUMBERED + 1).collect()
    if len(found) > NUMBERED:
        uses = with_terms(df, words).select(F.col(by).alias("by"), F.explode("terms").alias("term"))
        enough = uses.groupBy("by", "term").agg(F.count(F.lit(1)).alias("cf"))
    else:
        numbered = [r["term"] for r in found]
        pairs = _pair_names(_counted(df, words, numbered, by), numbered)
        enough = enough.unionByName(pairs.select("by", "term", "cf"))
    return enough.select(F.col("by").alias(by), "term", F.col("cf").alias("weight"))


def fit_vocabulary(
    df: DataFrame,
    terms: str = "terms",
    min_df: int = 5,
    max_df: float = 0.9,
    size: int = 8000,
    words: str | None = None,
) -> DataFrame:
    """The ``size`` most used terms within the document-frequency bounds.

    Columns term, term_id (alphabetical, from 0), cf, df and the smoothed idf
    ln((1 + n) / (1 + df)) + 1. Ties in use are settled by the term.

    ``words`` names a column of words without blanks, if ``terms`` are these and their pairs (:func:`with_terms`), in a
    written table. The result is the same, but pairs that cannot be chosen are not counted.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    counts = _leading_counts(df, words, min_df, max_df, size) if words else None
    chosen = (
        (term_counts(df, terms) if counts is None else counts)
        .filter((F.col("df") >= min_df) & (F.col("df") <= n * F.lit(max_df)))
        .orderBy(F.desc("cf"), F.asc("term"))
        .limit(size)
    )
    return chosen.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id"),
        "cf",
        "df",
        (F.log((n + 1).cast("double") / (F.col("df") + 1)) + 1.0).alias("idf"),
    )


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary; its length is bounded by the size asked for."""

    terms: list[str]
    idf: list[float]

    @classmethod
    def of(cls, fitted: DataFrame) -> Vocabulary:
        rows = sorted((r["term_id"], r["term"], r["idf"]) for r in fitted.collect())
        if not rows:
            raise ValueError("no term lies within the document-frequency bounds")
        return cls([r[1] for r in rows], [r[2] for r in rows])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(enumerate(self.terms)), "term_id int, term string"
        )


# Cells of the table that counts the terms of some rows.
CELLS = 1 << 20


def _word_vectors(vocabulary: Vocabulary) -> Callable[[pa.Array], pa.Array]:
    """A function from word lists to the TF-IDF vectors of their words and pairs; a null list has no words."""
    n_terms, idf = len(vocabulary.terms), np.array(vocabulary.idf, dtype=np.float64)
    number = {term: i for i, term in enumerate(vocabulary.terms)}
    # A pair is a term if a blank of the term parts its words.
    parted = [(t[:at], t[at + 1 :], i) for t, i in number.items() for at, c in enumerate(t) if c == " "]
    known = sorted({*number, *(p[0] for p in parted), *(p[1] for p in parted)})
    place = {word: i for i, word in enumerate(known)}
    alone = np.array([number.get(word, -1) for word in known], dtype=np.int64)
    pairs = pa.array([place[a] * len(known) + place[b] for a, b, _ in parted], pa.int64())
    pair_terms = np.array([i for *_, i in parted], dtype=np.int64)
    names = pa.array(known, pa.string())
    entry = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def found(items: pa.Array, among: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(items, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(lists: pa.Array) -> pa.Array:
        n = len(lists)
        rows = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        codes = found(lists.flatten(), names)
        single = np.where(codes >= 0, alone[codes], -1) if len(known) else codes
        both = np.flatnonzero((rows[1:] == rows[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0))
        joined = found(pa.array(codes[both] * len(known) + codes[both + 1]), pairs)
        both, joined = both[joined >= 0], pair_terms[joined[joined >= 0]]
        step = max(1, CELLS // n_terms)
        keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for first in range(0, n, step):
            a, b = np.searchsorted(rows, [first, first + step])
            c, d = np.searchsorted(both, [a, b])
            own = np.flatnonzero(single[a:b] >= 0) + a
            cells = [(rows[own] - first) * n_terms + single[own], (rows[both[c:d]] - first) * n_terms + joined[c:d]]
            table = np.bincount(np.concatenate(cells), minlength=1)
            filled = np.flatnonzero(table)
            keys.append(filled + first * n_terms)
            counts.append(table[filled])
        key, count = np.concatenate(keys), np.concatenate(counts)
        row, term = key // n_terms, key % n_terms
        weights = count * idf[term]
        norm = np.sqrt(np.bincount(row, weights=weights * weights, minlength=n))
        weights = weights / np.where(norm > 0, norm, 1.0)[row]
        offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        columns = [
            pa.array(np.zeros(n, dtype=np.int8)),
            pa.array(np.full(n, n_terms, dtype=np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(weights)),
        ]
        return pa.StructArray.from_arrays(columns, fields=list(entry))

    return run


def with_tfidf(
    df: DataFrame, vocabulary: Vocabulary, terms: str = "terms", output: str = "tfidf", words: str | None = None
) -> DataFrame:
    """Append the L2-normalized TF-IDF vector of the terms; no shuffle.

    ``words`` names a column of words, if the terms are these and their pairs (:func:`with_terms`). The vectors are the
    same, made for many rows at once; the pairs are never spelled out, and ``terms`` is not read.
    """
    if words:
        vector = F.arrow_udf(_word_vectors(vocabulary), VectorUDT(), ArrowUDFType.SCALAR)
        return df.withColumn(output, vector(F.col(words)))
    counts = CountVectorizerModel.from_vocabulary(
        vocabulary.terms, inputCol=terms, outputCol="_counts"
    )
    weighting = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf), inputCol="_counts", outputCol="_weighted"
    )
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
    weighted = weighting.transform(counts.transform(df))
    return unit.transform(weighted).drop("_counts", "_weighted")


def vector_entries(vector: Column) -> tuple[Column, Column]:
    """Index and value arrays of a sparse or dense vector column."""
    raw = F.unwrap_udt(vector)
    everywhere = F.sequence(F.lit(0), F.size(raw["values"]) - 1)
    indices = F.when(raw["type"] == 0, raw["indices"]).otherwise(everywhere)
    return indices, raw["values"]


def long_weights(df: DataFrame, key: str, vector: str, vocabulary: Vocabulary) -> DataFrame:
    """One row per document and term: key, term, weight."""
    indices, values = vector_entries(F.col(vector))
    entries = df.select(
        key,
        F.explode(F.arrays_zip(indices.alias("term_id"), values.alias("weight"))).alias("e"),
    ).select(key, "e.term_id", "e.weight")
    names = F.broadcast(vocabulary.frame(df.sparkSession))
    return entries.join(names, "term_id").select(key, "term", "weight")


def top_terms(weights: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` heaviest (term, weight) rows per group, ties by term."""
    order = Window.partitionBy(by).orderBy(F.desc("weight"), F.asc("term"))
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


