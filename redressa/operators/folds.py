"""Encoders for cross-validation, none of which has seen its held-out rows.

What an encoder is fitted on are sums: uses and documents of terms, rows of category levels, moments of numbers. Each sum is taken
by fold, all folds in one pass, and the encoder of a fold gets the total less that fold's own part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.operators.encoding import RARE, Encoder
from redressa.operators.vectors import Vocabulary, term_uses
from redressa.session import materialize


def _left_out(sums: DataFrame, by: Sequence[str], columns: Sequence[str], folds: Column) -> DataFrame:
    """Sums by ``fold`` and ``by`` turned into the sums over all other folds, for each of the ``folds``."""
    # One row per key, with its few folds; so a term is shuffled once, not once a fold.
    own = F.map_from_entries(F.collect_list(F.struct("fold", F.struct(*columns))))
    totals = sums.groupBy(*by).agg(own.alias("_own"), *[F.sum(c).alias(c) for c in columns])
    each = totals.withColumn("fold", F.explode(folds))
    part = F.try_element_at("_own", F.col("fold"))
    return each.select(
        "fold", *by, *[(F.col(c) - F.coalesce(part[c], F.lit(0))).alias(c) for c in columns]
    )


def _folds(k: int) -> Column:
    return F.sequence(F.lit(0), F.lit(k - 1))


def fold_vocabularies(
    df: DataFrame, k: int, terms: str = "terms", min_df: int = 5, max_df: float = 0.9, size: int = 6000
) -> DataFrame:
    """The vocabulary of each fold's train rows: fold, term, term_id, cf, df, idf.

    As :func:`redressa.operators.vectors.fit_vocabulary` makes it without the fold.
    """
    uses = term_uses(df, terms, ["fold"])
    counts, use = [], F.col("use")
    for fold in range(k):
        own = F.col("fold") == fold
        counts += [F.count_if(own & use).alias(f"cf{fold}"), F.count_if(own & ~use).alias(f"df{fold}")]
    sums = uses.groupBy("term").agg(F.count_if(use).alias("cf"), F.count_if(~use).alias("df"), *counts)
    # A term that is too rare in all rows is too rare in some of them.
    each = F.array(
        *[
            F.struct(
                F.lit(fold).alias("fold"),
                (F.col("cf") - F.col(f"cf{fold}")).alias("cf"),
                (F.col("df") - F.col(f"df{fold}")).alias("df"),
            )
            for fold in range(k)
        ]
    )
    left_out = sums.filter(F.col("df") >= min_df).select("term", F.inline(each))
    rows = df.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))
    rows = _left_out(rows.withColumn("all", F.lit(1)), ["all"], ["rows"], _folds(k)).select("fold", "rows")
    # One row a fold.
    counted = left_out.join(F.broadcast(rows), "fold")
    usable = counted.filter((F.col("df") >= min_df) & (F.col("df") <= F.col("rows") * F.lit(max_df)))
    used = Window.partitionBy("fold").orderBy(F.desc("cf"), "term")
    chosen = usable.withColumn("_place", F.row_number().over(used)).filter(F.col("_place") <= size)
    number = F.row_number().over(Window.partitionBy("fold").orderBy("term")) - 1
    idf = F.log((F.col("rows") + 1).cast("double") / (F.col("df") + 1)) + 1.0
    return chosen.select("fold", "term", number.alias("term_id"), "cf", "df", idf.alias("idf"))


def fold_levels(df: DataFrame, k: int, columns: Sequence[str], min_freq: int = 10) -> DataFrame:
    """fold, variable, level, n and the encoded name of the levels in each fold's train rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("level")) for c in columns])
    sums = df.select("fold", F.inline(pairs)).groupBy("fold", "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    found = _left_out(sums, ["variable", "level"], ["n"], _folds(k)).filter("n > 0")
    return found.withColumn("encoded", F.when(F.col("n") >= min_freq, F.col("level")).otherwise(RARE))


def fold_scales(df: DataFrame, k: int, numbers: Sequence[str]) -> DataFrame:
    """fold, feature, sd: the divisor of each number in each fold's train rows.

    Squares are taken around the mean of all rows, so that the difference of sums loses no digits.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in numbers])).scalar()
    off = F.array(
        *[F.struct(F.lit(c).alias("feature"), (F.col(c) - F.col("_means")[c]).alias("x")) for c in numbers]
    )
    sums = (
        df.withColumn("_means", means)
        .select("fold", F.inline(off))
        .groupBy("fold", "feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    )
    found = _left_out(sums, ["feature"], ["n", "x", "xx"], _folds(k))
    mean = F.try_divide("x", "n")
    variance = F.try_divide("xx", "n") - mean * mean
    sd = F.when(variance > 1e-12 * F.try_divide("xx", "n"), F.sqrt(variance)).otherwise(1.0)
    return found.select("fold", "feature", sd.alias("sd"))


def fold_encoders(
    df: DataFrame,
    k: int,
    categories: Sequence[str],
    numbers: Sequence[str],
    text: bool = True,
    min_freq: int = 10,
    **vocabulary,
) -> list[Encoder]:
    """One encoder for each fold, fitted on the rows of the others. ``df`` has ``fold`` and, with ``text``, ``terms``."""
    levels = materialize(fold_levels(df, k, categories, min_freq), "fold-levels")
    names: dict[int, set[str]] = {fold: set() for fold in range(k)}
    for row in levels.select("fold", "variable", "encoded").distinct().collect():
        names[row["fold"]].add(f"{row['variable']}={row['encoded']}")
    sds: dict[int, dict[str, float]] = {fold: {} for fold in range(k)}
    for row in fold_scales(df, k, numbers).collect():
        sds[row["fold"]][row["feature"]] = row["sd"]
    terms: dict[int, list] = {fold: [] for fold in range(k)}
    for row in fold_vocabularies(df, k, **vocabulary).collect() if text else ():
        terms[row["fold"]].append((row["term_id"], row["term"], row["idf"]))
    found = []
    for fold in range(k):
        own = sorted(terms[fold])
        found.append(
            Encoder(
                Vocabulary([t for _, t, _ in own], [i for _, _, i in own]) if own else None,
                tuple(sorted(names[fold])),
                levels.filter(F.col("fold") == fold).select("variable", "level", "encoded"),
                tuple(categories),
                tuple(numbers),
                tuple(sds[fold][c] for c in numbers),
            )
        )
    return found
