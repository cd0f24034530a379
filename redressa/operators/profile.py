"""Profile tables: frequencies, grouped means, comparisons, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.session import materialize
from redressa.functions.text import TEXT_MEASURES

NUMERIC_FEATURES = TEXT_MEASURES + ("post_cutoff",)

# Output columns and the measures they average.
RELIEF_RATES = {
    "any_relief_rate": "any_relief",
    "monetary_relief_rate": "monetary_relief",
    "non_monetary_relief_rate": "non_monetary_relief",
    "timely_rate": "timely_binary",
    "mean_words": "n_words",
}
MONTHLY_MEASURES = {**RELIEF_RATES, "template_phrase_rate": "template_phrase_count"}
PRODUCT_MEASURES = {
    **RELIEF_RATES,
    "legal_terms": "legal_term_count",
    "template_phrases": "template_phrase_count",
}
ISSUE_MEASURES = {
    "any_relief_rate": "any_relief",
    "timely_rate": "timely_binary",
    "mean_words": "n_words",
    "template_phrases": "template_phrase_count",
}
TOPIC_MEASURES = {**RELIEF_RATES, "template_phrases": "template_phrase_count"}
PERIOD_MEASURES = (
    "any_relief",
    "monetary_relief",
    "non_monetary_relief",
    "timely_binary",
    "n_words",
    "avg_sentence_len",
    "lexical_diversity",
    "legal_term_count",
    "evidence_term_count",
    "urgency_term_count",
    "hardship_term_count",
    "template_phrase_count",
)
FREQUENCY_COLUMNS = (
    "product_group",
    "product",
    "issue",
    "company",
    "state",
    "response_outcome",
)


def _mean(name: str) -> Column:
    return F.avg(F.col(name).cast("double"))


PROFILED = (
    "product",
    "issue",
    "company",
    "state",
    "date_received",
    "post_cutoff",
    "any_relief",
    "monetary_relief",
    "non_monetary_relief",
    "timely_binary",
    "n_words",
)


def dataset_profile(df: DataFrame, n_columns: int | None = None) -> DataFrame:
    """One row of fifteen figures about the modeling rows.

    The four distinct counts come from one pass of their own over the four
    columns, reduced to distinct values map-side. Next to the median they would
    multiply the rows of the wide pass and leave its one-group aggregation.
    """
    total = n_columns or len(df.columns)
    # Both passes read the narrow rows, which are made and written once.
    df = materialize(df.select(*PROFILED), "profile")
    distinct = count_distincts(df, ("product", "issue", "company", "state")).scalar()
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.date_format(F.min("date_received"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("date_received"), "yyyy-MM-dd").alias("date_max"),
        _mean("post_cutoff").alias("post_cutoff_share"),
        _mean("any_relief").alias("any_relief_rate"),
        _mean("monetary_relief").alias("monetary_relief_rate"),
        _mean("non_monetary_relief").alias("non_monetary_relief_rate"),
        _mean("timely_binary").alias("timely_response_rate"),
        F.percentile("n_words", F.lit(0.5)).alias("median_words"),
        _mean("n_words").alias("mean_words"),
    )
    return wide.withColumn("_distinct", distinct).select(
        *wide.columns,
        F.col("_distinct.product").alias("unique_products"),
        F.col("_distinct.issue").alias("unique_issues"),
        F.col("_distinct.company").alias("unique_companies"),
        F.col("_distinct.state").alias("unique_states"),
        F.lit(total).cast("bigint").alias("columns"),
    )


def count_distincts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, one struct: the number of distinct non-null values per column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in columns]
    )
    values = df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()
    return values.agg(
        F.struct(*[F.count_if(F.col("variable") == c).alias(c) for c in columns])
    )


def value_shares(
    df: DataFrame, columns: Sequence[str] = FREQUENCY_COLUMNS, top: int = 50
) -> DataFrame:
    """Most frequent values of each column with their share of all rows, in long form.

    One scan and one shuffle: the totals are counted as a second grouping set,
    lead each column's ranking, and so come along with its top values.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c), F.lit("Missing")).alias("value"))
            for c in columns
        ]
    )
    counts = (
        df.select(F.inline(pairs))
        .groupingSets([["variable", "value"], ["variable"]], "variable", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("value").alias("_whole"))
    )
    ranked = Window.partitionBy("variable").orderBy(F.desc("_whole"), F.desc("n"), F.asc("value"))
    whole = F.max(F.when(F.col("_whole") == 1, F.col("n"))).over(Window.partitionBy("variable"))
    return (
        counts.withColumn("_place", F.row_number().over(ranked))
        .filter(F.col("_place") <= top + 1)
        .withColumn("share", F.col("n") / whole)
        .filter("_whole = 0")
        .select("variable", "value", "n", "share", (F.col("_place") - 1).alias("rank"))
    )


def value_share(df: DataFrame, column: str, top: int = 50) -> DataFrame:
    """Most frequent values of one column with their share of all rows."""
    return (
        value_shares(df, [column], top)
        .orderBy("rank")
        .select(F.col("value").alias(column), "n", "share")
    )


def group_rates(
    df: DataFrame,
    by: str,
    measures: Mapping[str, str],
    min_n: int = 1,
    top: int | None = None,
    share: bool = False,
) -> DataFrame:
    """Row count and means per non-null group, largest group first."""
    grouped = (
        df.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[_mean(source).alias(name) for name, source in measures.items()],
        )
    )
    if share:
        total = grouped.agg(F.sum("n")).scalar()
        grouped = grouped.withColumn("share", F.col("n") / total)
    if min_n > 1:
        grouped = grouped.filter(F.col("n") >= min_n)
    ordered = grouped.orderBy(F.desc("n"), F.asc(by))
    return ordered if top is None else ordered.limit(top)


def monthly_profile(df: DataFrame) -> DataFrame:
    return group_rates(df, "complaint_month", MONTHLY_MEASURES).orderBy("complaint_month")


def product_response(df: DataFrame) -> DataFrame:
    return group_rates(df, "product_group", PRODUCT_MEASURES)


def issue_response(df: DataFrame, min_n: int = 50, top: int = 50) -> DataFrame:
    return group_rates(df, "issue", ISSUE_MEASURES, min_n, top)


def topic_profile(df: DataFrame, topic: str = "dominant_topic") -> DataFrame:
    return group_rates(df, topic, TOPIC_MEASURES, share=True)


def compare_groups(
    df: DataFrame,
    flag: str = "post_cutoff",
    measures: Sequence[str] = PERIOD_MEASURES,
    labels: tuple[str, str] = ("before", "after"),
) -> DataFrame:
    """Means of the measures on both sides of a 0/1 flag."""
    return (
        df.filter(F.col(flag).isNotNull())
        .groupBy(flag)
        .agg(*[_mean(m).alias(m) for m in measures])
        .withColumn("period", F.when(F.col(flag) == 1, labels[1]).otherwise(labels[0]))
    )


def correlate_with(
    df: DataFrame, features: Sequence[str] = NUMERIC_FEATURES, target: str = "any_relief"
) -> DataFrame:
    """Pearson correlation of each feature with the target, strongest first.

    Pairs with a null on either side are left out; a constant side gives null.
    """
    y = F.col(target).cast("double")
    sums = []
    for f in features:
        x = F.col(f).cast("double")
        both = x.isNotNull() & y.isNotNull()
        sums += [
            F.covar_pop(F.when(both, x), F.when(both, y)).alias(f"{f}_xy"),
            F.stddev_pop(F.when(both, x)).alias(f"{f}_x"),
            F.stddev_pop(F.when(both, y)).alias(f"{f}_y"),
        ]
    moments = df.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.try_divide(
                    F.col(f"{f}_xy"), F.col(f"{f}_x") * F.col(f"{f}_y")
                ).alias("correlation"),
            )
            for f in features
        ]
    )
    return moments.select(F.inline(rows)).orderBy(
        F.desc_nulls_last(F.abs("correlation")), F.asc("feature")
    )
