"""From raw records to the cleaned table and the modeling rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redressa.functions import fields
from redressa.functions.text import STRUCTURE_MEASURES, TEXT_MEASURES, with_text_measures
from redressa.sources.schema import ALIASES, DEFINITIONS

DERIVED_COLUMNS = (
    "has_narrative",
    "product_group",
    "timely_binary",
    "consumer_disputed_binary",
    "days_to_company",
    "complaint_year",
    "complaint_month",
    "complaint_quarter",
    "post_cutoff",
)


def header_name(name: str) -> str:
    """Lower-case header with every run of other characters as one ``_``."""
    words = re.findall(r"[a-z0-9]+", name.lower().replace("?", ""))
    return "_".join(words)


def union_sources(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of sources with different columns, each row tagged with its source."""
    tagged = [df.withColumn("raw_source", F.lit(name)) for name, df in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def source_manifest(df: DataFrame) -> DataFrame:
    """Rows per source, and in total under the name ``all sources``."""
    return (
        df.rollup("raw_source")
        .agg(F.count(F.lit(1)).alias("rows"), F.grouping("raw_source").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, F.lit("all sources"))
            .otherwise(F.coalesce("raw_source", F.lit("unnamed")))
            .alias("raw_source"),
            "rows",
        )
    )


def standardize(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project onto the canonical columns; the first non-null alias wins.

    NA texts are null, whatever kind of source they came from.

    Headers that become equal are told apart by position, left to right.
    """
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    places: dict[str, list[Column]] = {}
    for i, name in enumerate(df.columns):
        places.setdefault(header_name(name), []).append(F.col(f"c{i}"))
    picked = []
    for target, accepted in aliases.items():
        found = [
            fields.null_if_na(c.cast("string")) for name in accepted for c in places.get(name, [])
        ]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        picked.append(value.alias(target))
    extra = [F.col(f"c{df.columns.index(name)}").alias(name) for name in keep]
    return numbered.select(*extra, *picked)


def first_per_key(df: DataFrame, key: str, order: str = "ingest_seq") -> DataFrame:
    """Keep the row that came first for each key; null keys count as one key.

    ``row_number() = 1`` lets Spark keep one row per key and map task before
    the shuffle, so a key that holds a third of the rows costs no more.
    """
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def with_derived_fields(df: DataFrame, cutoff: str = fields.DEFAULT_CUTOFF) -> DataFrame:
    """Append the nine derived fields and the six response fields."""
    received = F.col("date_received")
    derived = {
        "product_group": fields.product_group(F.col("product")),
        "timely_binary": fields.parse_yes_no(F.col("timely_response")),
        "consumer_disputed_binary": fields.parse_yes_no(F.col("consumer_disputed")),
        "days_to_company": fields.whole_days(received, F.col("date_sent_to_company")),
        **fields.calendar_fields(received, cutoff),
        **fields.response_classes(F.col("company_response")),
    }
    return df.select("*", *[c.alias(n, metadata=_note(n)) for n, c in derived.items()])


def _note(name: str) -> dict:
    return {"comment": DEFINITIONS[name]} if name in DEFINITIONS else {}


def _parsed_dates(df: DataFrame) -> DataFrame:
    for name in ("date_received", "date_sent_to_company"):
        if isinstance(df.schema[name].dataType, T.StringType):
            df = df.withColumn(name, fields.parse_date(F.col(name)))
    return df


def clean_complaints(
    df: DataFrame,
    cutoff: str = fields.DEFAULT_CUTOFF,
    order: str = "ingest_seq",
    measures: Sequence[str] = TEXT_MEASURES,
    measure_kept: bool = False,
    batched: bool = False,
) -> DataFrame:
    """Cleaned complaints: 19 canonical, 15 derived and 19 text columns.

    The expression index also needs ``STRUCTURE_MEASURES``; name them in ``measures``.

    The text is measured before the dedup: a narrow row of numbers is then
    shuffled, and the narrative only when a later step reads it. If one does, ``measure_kept`` leaves the
    measures to the rows that the dedup, and filters on other columns after it, keep. ``batched`` is for
    callers that need most measures (:func:`with_text_measures`).
    """
    measured = {*TEXT_MEASURES, *STRUCTURE_MEASURES}
    dated = _parsed_dates(df).withColumn(
        "consumer_narrative", F.coalesce("consumer_narrative", F.lit(""))
    )
    if "has_narrative" not in df.columns:
        dated = dated.withColumn("has_narrative", fields.has_text(F.col("consumer_narrative")))
    unmeasured = not set(measures) <= set(df.columns)
    if unmeasured and not measure_kept:
        dated = with_text_measures(dated.drop(*measured), batched=batched)
    kept = first_per_key(dated, "complaint_id", order).drop(order)
    if unmeasured and measure_kept:
        kept = with_text_measures(kept.drop(*measured), batched=batched)
    derived = with_derived_fields(kept, cutoff)
    canonical = [c for c in ALIASES]
    middle = [c for c in derived.columns if c not in canonical and c not in measured]
    return derived.select(
        *canonical, *middle, *[F.col(m).alias(m, metadata=_note(m)) for m in measures]
    )


def modeling_rows(df: DataFrame) -> DataFrame:
    """Rows with a narrative, a received date and a company response."""
    return df.filter(
        (F.col("has_narrative") == 1)
        & F.col("date_received").isNotNull()
        & F.col("company_response").isNotNull()
    )


def cleaning_audit(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Row counts and date range along the cleaning steps, in one job.

    ``raw`` needs complaint_id, date_received, company_response, has_narrative
    and the ingest order.
    """
    usable = (
        (F.col("has_narrative") == 1)
        & F.col("date_received").isNotNull()
        & F.col("company_response").isNotNull()
    )
    # A usable row has a date, so the date alone tells whether the first copy is one.
    received = F.when(usable, F.col("date_received"))
    first = raw.groupBy("complaint_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min_by(received, F.col(order)).alias("received")
    )
    return first.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"),
        F.count(F.lit(1)).alias("deduplicated_rows"),
        F.count("received").alias("modeling_rows"),
        F.date_format(F.min("received"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("received"), "yyyy-MM-dd").alias("date_max"),
    )


def audit_counts(cleaned: DataFrame, usable: DataFrame, raw_rows: int) -> dict:
    """The same record from written tables, one pass over narrow columns."""
    dates = usable.agg(
        F.count(F.lit(1)).alias("modeling_rows"),
        F.date_format(F.min("date_received"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("date_received"), "yyyy-MM-dd").alias("date_max"),
    ).first()
    return {"raw_rows": raw_rows, "deduplicated_rows": cleaned.count(), **dates.asDict()}


def feature_dictionary(df: DataFrame) -> DataFrame:
    """Commented columns of ``df``: name, definition and rows with a value."""
    noted = [(f.name, f.metadata["comment"]) for f in df.schema.fields if "comment" in f.metadata]
    counted = df.agg(*[F.count(F.col(name)).alias(name) for name, _ in noted])
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("variable"),
                F.lit(note).alias("definition"),
                F.col(name).alias("rows_with_value"),
            )
            for name, note in noted
        ]
    )
    return counted.select(F.inline(rows))
