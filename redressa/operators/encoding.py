"""Model inputs: filled columns, pooled category levels, scaled numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.operators.vectors import Vocabulary, with_tfidf
from redressa.session import materialize

CATEGORICAL_FEATURES = ("product_group", "submitted_via", "state")
RARE = "infrequent"


def fill_inputs(df: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Null categories become 'Missing'; null or unreadable numbers become 0."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in categories}
    filled |= {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numbers}
    return df.withColumns(filled)


def rare_levels(train: DataFrame, columns: Sequence[str], min_freq: int = 10) -> DataFrame:
    """Train rows per category level, and the name the encoder gives it.

    Levels under ``min_freq`` rows share one name per column.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).alias("level")) for c in columns]
    )
    return (
        train.select(F.inline(pairs))
        .groupBy("variable", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("encoded", F.when(F.col("n") >= min_freq, F.col("level")).otherwise(RARE))
    )


def population_sd(train: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """One row: the divisor of each column, its population sd, or 1 if that is 0."""
    sd = {c: F.stddev_pop(c) for c in numbers}
    return train.agg(
        *[F.when(s > 0, s).otherwise(F.lit(1.0)).alias(c) for c, s in sd.items()]
    )


def scale_by_sd(df: DataFrame, train: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Divide each column by its train population sd, without centering."""
    sds = population_sd(train, numbers)
    divisors = F.col("_divisors")
    return (
        df.withColumn("_divisors", sds.select(F.struct(*numbers)).scalar())
        .withColumns({c: F.col(c) / divisors[c] for c in numbers})
        .drop("_divisors")
    )


@dataclass(frozen=True)
class Encoder:
    """Fitted on train rows; the names follow the order of the vector entries.

    Categories are encoded as words ``column=level`` of a binary vocabulary. ``seen`` is
    a written table of every level in training and its encoded name, joined to the rows:
    rare levels are never listed, and a level not seen in training has no name, is an
    unknown word, and leaves zeros.
    """

    vocabulary: Vocabulary | None
    levels: tuple[str, ...]
    seen: DataFrame
    categories: tuple[str, ...]
    numbers: tuple[str, ...]
    sds: tuple[float, ...]

    @property
    def names(self) -> list[str]:
        words = self.vocabulary.terms if self.vocabulary else []
        return [*words, *self.levels, *self.numbers]

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        vocabulary: Vocabulary | None,
        categories: Sequence[str],
        numbers: Sequence[str],
        min_freq: int = 10,
    ) -> Encoder:
        seen = materialize(rare_levels(train, categories, min_freq), "levels")
        # The names of the model's own entries: frequent levels and one pool a column.
        names = seen.select("variable", "encoded").distinct().collect()
        sds = population_sd(train, numbers).first()
        return cls(
            vocabulary,
            tuple(sorted(f"{r['variable']}={r['encoded']}" for r in names)),
            seen.select("variable", "level", "encoded"),
            tuple(categories),
            tuple(numbers),
            tuple(sds[c] for c in numbers),
        )

    def _named(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_levels``, the words of its categories."""
        words = []
        for i, column in enumerate(self.categories):
            own = self.seen.filter(F.col("variable") == column).select(
                F.col("level").alias(f"_level{i}"), F.col("encoded").alias(f"_name{i}")
            )
            df = df.join(own, F.col(column) == F.col(f"_level{i}"), "left")
            words.append(F.concat(F.lit(f"{column}="), F.col(f"_name{i}")))
        helpers = [f"_{kind}{i}" for i in range(len(words)) for kind in ("level", "name")]
        return df.withColumn("_levels", F.array_compact(F.array(*words))).drop(*helpers)

    def transform(
        self, df: DataFrame, terms: str = "terms", output: str = "features", words: str | None = None
    ) -> DataFrame:
        """Append the features; ``words`` may name the words of the ``terms``, as in :func:`with_tfidf`."""
        parts = []
        out = df
        if self.vocabulary:
            out = with_tfidf(out, self.vocabulary, terms, "_text", words)
            parts.append("_text")
        out = self._named(out)
        out = CountVectorizerModel.from_vocabulary(
            list(self.levels), inputCol="_levels", outputCol="_cats"
        ).transform(out)
        out = VectorAssembler(inputCols=list(self.numbers), outputCol="_numbers").transform(out)
        out = ElementwiseProduct(
            scalingVec=Vectors.dense([1.0 / s for s in self.sds]),
            inputCol="_numbers",
            outputCol="_scaled",
        ).transform(out)
        parts += ["_cats", "_scaled"]
        out = VectorAssembler(inputCols=parts, outputCol=output).transform(out)
        return out.drop(*parts, "_levels", "_numbers")


