"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.session import configure

Query = Callable[[SparkSession, str], DataFrame]

# White space that separates words, for Spark's (Java's) patterns.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def map_rows(df: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` whose column ``key`` travels as a string in both directions.

    Pandas would read whole numbers with a null among them as floats.
    """
    kind = df.schema[key].dataType
    found = df.withColumn(key, F.col(key).cast("string")).mapInPandas(run, f"{key} string, {schema}")
    return found.withColumn(key, F.col(key).cast(kind))


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name."""
    names = {t.lower() for t in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted
