"""Whole runs: fetch, clean, profile, topics, models, and the run summary.

Each run reads tables, writes tables, and returns a frame that reads what was
written. Small result tables are CSV and JSON, wide ones Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from redressa.functions.fields import DEFAULT_CUTOFF
from redressa.operators import cleaning, models, profile, topics, vectors
from redressa.session import configure, discard, materialize
from redressa.sources.readers import INGEST, read_table
from redressa.sources.writers import write_once, write_record, write_table

TARGETS = ("any_relief", "timely_binary")


@dataclass(frozen=True)
class Source:
    name: str
    path: str
    fmt: str


def fetch(
    spark: SparkSession, sources: Sequence[Source], out_dir: str, force: bool = False
) -> DataFrame:
    """Union of the sources in canonical columns; the manifest is written.

    Each source is kept as a Parquet copy, taken again only with ``force``.
    """
    configure(spark)
    copies = []
    for number, source in enumerate(sources):
        raw = read_table(spark, source.path, source.fmt, number)
        columns = cleaning.standardize(raw, keep=(INGEST,))
        copy = write_once(columns, f"{out_dir}/sources/{source.name}", force)
        copies.append((source.name, copy))
    combined = cleaning.union_sources(copies)
    counts = {r["raw_source"]: r["rows"] for r in cleaning.source_manifest(combined).collect()}
    record = {
        "rows": counts.get("all sources", 0),
        "sources": [
            {"name": s.name, "path": s.path, "format": s.fmt, "rows": counts.get(s.name, 0)}
            for s in sources
        ],
    }
    write_record(spark, record, f"{out_dir}/source_manifest.json")
    return combined


def clean(raw: DataFrame, out_dir: str, cutoff: str = DEFAULT_CUTOFF) -> DataFrame:
    """Write the cleaned table (by year), the dictionary and the audit; return modeling rows."""
    spark = raw.sparkSession
    cleaned = cleaning.clean_complaints(raw, cutoff)
    path = f"{out_dir}/complaints"
    write_table(cleaned, path, partition_by="complaint_year")
    written = spark.read.parquet(path).select(*cleaned.columns)
    write_table(cleaning.feature_dictionary(written), f"{out_dir}/feature_dictionary", "csv")
    usable = cleaning.modeling_rows(written)
    facts = cleaning.audit_counts(written, usable, raw.count())
    write_record(spark, facts, f"{out_dir}/cleaning_metadata.json")
    return usable


def profile_tables(df: DataFrame, table_dir: str) -> dict:
    """Write every profile table of the modeling rows; return the dataset profile."""
    spark = df.sparkSession
    record = profile.dataset_profile(df).first().asDict()
    write_record(spark, record, f"{table_dir}/dataset_profile.json")
    tables = {
        "frequencies": profile.value_shares(df),
        "monthly_profile": profile.monthly_profile(df),
        "product_response_rates": profile.product_response(df),
        "issue_response_rates": profile.issue_response(df),
        "period_summary": profile.compare_groups(df),
        "feature_correlations": profile.correlate_with(df),
    }
    for name, result in tables.items():
        write_table(result, f"{table_dir}/{name}", "csv")
    return record


def topic_tables(df: DataFrame, table_dir: str, out_dir: str, **options) -> DataFrame:
    """Fit topics; write keywords, topic profile and the table with topics; return it."""
    worded = vectors.narrative_words(df)
    words = materialize(worded.select("complaint_id", "kept_words"), "words")
    sparse, model = topics.fit_topics(words, "complaint_id", **options)
    write_table(model.keywords(df), f"{table_dir}/topic_keywords", "csv")
    path = f"{out_dir}/complaints_with_topics"
    write_table(model.label(worded).drop("kept_words"), path)
    discard(words, sparse)
    written = df.sparkSession.read.parquet(path)
    write_table(profile.topic_profile(written), f"{table_dir}/topic_response_rates", "csv")
    return written


def model_tables(df: DataFrame, target: str, table_dir: str, model_dir: str, **options) -> dict:
    """Fit one response model; write its metrics, class report and top features."""
    spark = df.sparkSession
    fitted = models.fit_response_model(df, target, **options)
    if isinstance(fitted, dict):
        write_record(spark, fitted, f"{model_dir}/model_metrics_{target}.json")
        return fitted
    record = fitted.metrics().first().asDict()
    write_record(spark, record, f"{model_dir}/model_metrics_{target}.json")
    write_table(fitted.class_report(), f"{model_dir}/class_report_{target}", "csv")
    write_table(fitted.top_features(), f"{table_dir}/model_top_features_{target}", "csv")
    return record


def run_all(
    spark: SparkSession,
    sources: Sequence[Source],
    out_dir: str,
    cutoff: str = DEFAULT_CUTOFF,
    force: bool = False,
    topic_options: dict | None = None,
    model_options: dict | None = None,
) -> dict:
    """Fetch, clean, profile, topics and both models; write and return the summary."""
    tables, fitted = f"{out_dir}/tables", f"{out_dir}/models"
    usable = clean(fetch(spark, sources, f"{out_dir}/raw", force), f"{out_dir}/clean", cutoff)
    summary: dict = {"profile": profile_tables(usable, tables)}
    topical = topic_tables(usable, tables, f"{out_dir}/clean", **(topic_options or {}))
    summary["models"] = {
        target: model_tables(topical, target, tables, fitted, **(model_options or {}))
        for target in TARGETS
    }
    summary["outputs"] = {"tables": tables, "models": fitted, "clean": f"{out_dir}/clean"}
    write_record(spark, summary, f"{tables}/run_summary.json")
    return summary
