"""One query per operator over the given tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redressa.functions import fields, text
from redressa.functions.lexicons import LEXICONS
from redressa.operators import (
    absorption,
    cleaning,
    encoding,
    folds,
    isotonic,
    metrics,
    models,
    profile,
    shift,
    splitting,
    topics,
    vectors,
)
from redressa.session import configure, discard, fresh_path, materialize, spread
from redressa.sources.complaint_view import CUTOFF, complaint_rows, narratives
from redressa.sources.readers import file_sizes, read_csv, read_hits, read_parquet
from redressa.sources.writers import write_once, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MATCHED = ("issue", "company", "state")
MODEL_COLUMNS = ("product", "submitted_via", "state", "timely_response", *text.TEXT_MEASURES)


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned(spark: SparkSession, sf_dir: str, *columns: str, batched: bool = False) -> DataFrame:
    # A narrative that is asked for goes through the dedup anyway: it is measured after it, on the rows that are left.
    carried = "consumer_narrative" in columns
    rows = complaint_rows(spark, sf_dir, {"date_received", "company_response", *columns}, measured=not carried)
    measures = (*text.TEXT_MEASURES, *text.STRUCTURE_MEASURES)
    return cleaning.clean_complaints(rows, CUTOFF, measures=measures, measure_kept=carried, batched=batched)


def modeling(spark: SparkSession, sf_dir: str, *columns: str, batched: bool = False) -> DataFrame:
    return cleaning.modeling_rows(cleaned(spark, sf_dir, *columns, batched=batched))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a float sum does not show."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def stamp(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narratives(configure(spark), sf_dir).withColumn(
        "consumer_narrative", F.coalesce("consumer_narrative", F.lit(""))
    )


def measured(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> DataFrame:
    docs = spread(documents(spark, sf_dir), "doc_id")
    return text.with_text_measures(docs).select("complaint_id", *names)


# --- sources and set operations -------------------------------------------


@query("raw_complaints")
def raw_complaints(spark, sf_dir):
    rows = complaint_rows(spark, sf_dir)
    return rows.select(
        "ingest_seq",
        "complaint_id",
        "raw_source",
        stamp(F.col("date_received")).alias("date_received"),
        stamp(F.col("date_sent_to_company")).alias("date_sent_to_company"),
        "product",
        "issue",
        "sub_issue",
        "consumer_narrative",
        "company",
        "state",
        "submitted_via",
        "company_response",
        "timely_response",
        "consumer_disputed",
    )


@query("recent_complaints")
def recent_complaints(spark, sf_dir, start="1996-01-01", end="2000-12-31", limit=500):
    rows = complaint_rows(spark, sf_dir, {"date_received"}, replay=False)
    return (
        rows.filter(F.col("date_received").between(start, end) & (F.col("has_narrative") == 1))
        .orderBy(F.desc("date_received"), F.asc("complaint_id"))
        .limit(limit)
        .select("complaint_id", stamp(F.col("date_received")).alias("date_received"), "raw_source")
    )


def _two_sources(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("complaint_id"),
        F.col("text").alias("consumer_narrative"),
        "lang",
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("complaint_id"),
        F.col("text").alias("complaint_what_happened"),
        "role",
    )
    return cleaning.union_sources([("documents", docs), ("conversations", turns)])


@query("source_union")
def source_union(spark, sf_dir):
    return _two_sources(spark, sf_dir).select(
        "raw_source", "complaint_id", "consumer_narrative", "complaint_what_happened", "lang", "role"
    )


@query("source_manifest")
def source_manifest(spark, sf_dir):
    return cleaning.source_manifest(complaint_rows(spark, sf_dir, set()))


@query("na_tokens")
def na_tokens(spark, sf_dir):
    doc = F.col("doc_id")
    value = F.col("source")
    for i, token in enumerate(("N/A", "None", "", "nan", "NULL", "#N/A", "none", "N/A ")):
        value = F.when(doc % 11 == i, F.lit(token)).otherwise(value)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", value.alias("value"))
        .withColumn("value", fields.null_if_na(F.col("value")))
    )


@query("csv_scan")
def csv_scan(spark, sf_dir):
    """Narratives written as CSV and read back: quotes, commas, line breaks, NA texts."""
    path = fresh_path(configure(spark), "csv")
    rows = narratives(spark, sf_dir).select(
        F.col("complaint_id").alias("Complaint ID"),
        F.col("consumer_narrative").alias("Consumer complaint narrative"),
        F.when(F.col("doc_id") % 5 == 0, "N/A").otherwise(F.col("raw_source")).alias("State"),
    )
    write_table(rows, path, "csv")
    return cleaning.standardize(read_csv(spark, path)).select(
        "complaint_id", "consumer_narrative", "state"
    )


# Bytes of documents in a CSV file that stands for a download: more than one task scans.
CSV_BYTES = 256 << 20


@query("csv_blocks")
def csv_blocks(spark, sf_dir):
    """Narratives in large CSV files, each of them cut into records by many tasks."""
    path = fresh_path(configure(spark), "csv")
    rows = narratives(spark, sf_dir).select(
        F.col("complaint_id").alias("Complaint ID"),
        F.col("consumer_narrative").alias("Consumer complaint narrative"),
        F.when(F.col("doc_id") % 5 == 0, "N/A").otherwise(F.col("raw_source")).alias("State"),
    )
    # Few files are the point here: they stand for large downloads. One task writes each, so their size is bounded.
    size = sum(file_sizes(spark, [f"{sf_dir}/documents.parquet"]).values())
    write_table(rows.coalesce(size // CSV_BYTES + 1), path, "csv")
    return cleaning.standardize(read_csv(spark, path, whole_bytes=0)).select(
        "complaint_id", "consumer_narrative", "state"
    )


def _odd_and_even(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as two sources with other columns, in another order, and NA texts."""
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    na = F.when(F.col("doc_id") % 5 == 0, "N/A").when(F.col("doc_id") % 7 == 0, "None")
    even = docs.filter("doc_id % 2 = 0").select(
        F.col("id").alias("Complaint ID"), na.otherwise(F.col("source")).alias("State"), F.col("lang").alias("Product")
    )
    odd = docs.filter("doc_id % 2 = 1").select(
        F.col("source").alias("State"), F.col("id").alias("Complaint ID"), na.otherwise(F.col("lang")).alias("Issue")
    )
    return even, odd


_MIXED = ("complaint_id", "state", "product", "issue")


@query("csv_mixed_headers")
def csv_mixed_headers(spark, sf_dir):
    """One folder of CSV files with different headers, read back by column name."""
    path = fresh_path(configure(spark), "mixed")
    for part in _odd_and_even(spark, sf_dir):
        part.write.mode("append").option("header", True).csv(path)
    return cleaning.standardize(read_csv(spark, path)).select(*_MIXED)


@query("parquet_mixed_columns")
def parquet_mixed_columns(spark, sf_dir):
    """One folder of Parquet files with different columns, NA texts among them."""
    path = fresh_path(configure(spark), "mixed")
    for part in _odd_and_even(spark, sf_dir):
        part.toDF(*[c.replace(" ", "_") for c in part.columns]).write.mode("append").parquet(path)
    return cleaning.standardize(read_parquet(spark, path)).select(*_MIXED)


@query("sink_round_trip")
def sink_round_trip(spark, sf_dir):
    """The cleaned rows written in each format and read back, tagged with it."""
    rows = cleaned(spark, sf_dir, "product").select(
        "complaint_id", "product_group", "complaint_year", "response_outcome"
    )
    rows = materialize(rows, "sinks")
    parts = []
    for fmt in ("parquet", "csv", "json"):
        path = fresh_path(spark, "sink")
        by = "complaint_year" if fmt == "parquet" else None
        write_table(rows, path, fmt, by)
        reader = spark.read.schema(rows.schema)
        back = reader.option("header", True).csv(path) if fmt == "csv" else getattr(reader, fmt)(path)
        parts.append(back.select(F.lit(fmt).alias("fmt"), *rows.columns))
    return parts[0].union(parts[1]).union(parts[2])


@query("source_copy")
def source_copy(spark, sf_dir):
    """A finished copy is kept when other rows come for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    path = fresh_path(spark, "copy")
    write_once(docs, path)
    return write_once(docs.filter("doc_id < 0"), path)


@query("api_hits")
def api_hits(spark, sf_dir):
    """Documents as search replies in three envelopes, read back as records."""
    path = fresh_path(configure(spark), "hits")
    record = F.struct(F.col("doc_id").alias("complaint_id"), F.col("lang").alias("state"), "text")
    wrapped = F.array(F.struct(record.alias("_source")))
    reply = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.struct(wrapped.alias("hits")).alias("hits"))))
        .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(wrapped.alias("hits"))))
        .otherwise(F.to_json(F.struct(F.array(record).alias("hits"))))
    )
    table(spark, sf_dir, "documents").select(reply.alias("value")).write.text(path)
    return read_hits(spark, path, ["complaint_id", "state", "text"], one_per_line=True)


# --- projection, cleaning, predicates -------------------------------------


@query("alias_coalesce")
def alias_coalesce(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    flag = F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No")
    raw = docs.select(
        F.col("doc_id").alias("Complaint ID"),
        F.when(F.col("lang") == "en", F.col("text")).alias("Complaint: what happened"),
        F.when(F.col("quality") == 1, F.col("text")).alias("Consumer complaint narrative"),
        F.concat(F.lit("short "), "source").alias("consumer_narrative"),
        flag.alias("Timely response?"),
        F.lit("Yes").alias("timely"),
        F.col("source").alias("ZIP"),
        F.when(F.col("toxic") == 0, F.col("lang")).alias("State?"),
        F.col("source").alias(" state "),
    )
    return cleaning.standardize(raw).select(
        "complaint_id", "consumer_narrative", "timely_response", "zip_code", "state", "company"
    )


@query("parse_dates")
def parse_dates(spark, sf_dir):
    day, key = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    written = (
        F.when(key % 13 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 13 == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(key % 13 == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(key % 13 == 3, F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(key % 13 == 4, F.date_format(day, "MMMM d, yyyy"))
        .when(key % 13 == 5, F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd")))
        .when(key % 13 == 6, F.concat(F.lit("  "), F.date_format(day, "yyyy-M-d"), F.lit(" ")))
        .when(key % 13 == 7, F.concat(F.date_format(day, "EEE, d MMM yyyy"), F.lit(" 10:15 PM")))
        .when(key % 13 == 8, F.date_format(day, "dd-MMM-yyyy"))
        .when(key % 13 == 9, F.concat(F.date_format(day, "MMM'.' d, yyyy")))
        .when(key % 13 == 10, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T01:02:03.1234567+0000")))
        .when(key % 13 == 11, F.date_format(day, "yyyy-MM"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", stamp(fields.parse_date(written)).alias("parsed")
    )


@query("parse_binary")
def parse_binary(spark, sf_dir):
    key = F.col("event_id")
    written = F.col("event_type")
    for i, value in enumerate((" YES ", "y", "True", "1", "no", "N\t", "FALSE", "0", "2", "")):
        written = F.when(key % 12 == i, F.lit(value)).otherwise(written)
    return table(spark, sf_dir, "events").select(
        "event_id", fields.parse_yes_no(written).alias("flag")
    )


@query("dedup_first")
def dedup_first(spark, sf_dir):
    rows = complaint_rows(spark, sf_dir, {"consumer_narrative"})
    return cleaning.first_per_key(rows, "complaint_id").select(
        "complaint_id", "ingest_seq", "raw_source", "consumer_narrative"
    )


@query("has_narrative")
def has_narrative(spark, sf_dir):
    return narratives(configure(spark), sf_dir, replay=True).select(
        "ingest_seq", fields.has_text(F.col("consumer_narrative")).alias("has_narrative")
    )


@query("product_group")
def product_group(spark, sf_dir):
    return cleaned(spark, sf_dir, "product").select("complaint_id", "product", "product_group")


@query("response_outcome")
def response_outcome(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "complaint_id", "company_response", *fields.RESPONSE_COLUMNS
    )


@query("days_to_company")
def days_to_company(spark, sf_dir):
    return cleaned(spark, sf_dir, "date_sent_to_company").select("complaint_id", "days_to_company")


@query("calendar_keys")
def calendar_keys(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "complaint_id", "complaint_year", "complaint_month", "complaint_quarter", "post_cutoff"
    )


@query("modeling_rows")
def modeling_rows(spark, sf_dir):
    return modeling(spark, sf_dir, "product").select(
        "complaint_id", "complaint_month", "product_group", "response_outcome"
    )


@query("cleaning_audit")
def cleaning_audit(spark, sf_dir):
    return cleaning.cleaning_audit(
        complaint_rows(spark, sf_dir, {"date_received", "company_response"})
    )


@query("feature_dictionary")
def feature_dictionary(spark, sf_dir):
    return cleaning.feature_dictionary(modeling(spark, sf_dir, "product", "timely_response"))


# --- text measures --------------------------------------------------------


@query("text_tokens")
def text_tokens(spark, sf_dir):
    words = text.tokens(F.lower("consumer_narrative"))
    return spread(documents(spark, sf_dir), "doc_id").select(
        "complaint_id", F.posexplode(words).alias("position", "token")
    )


@query("text_shape")
def text_shape(spark, sf_dir):
    return rounded(measured(spark, sf_dir, text.SHAPE_MEASURES))


@query("text_chars")
def text_chars(spark, sf_dir):
    return rounded(measured(spark, sf_dir, text.CHARACTER_MEASURES))


@query("text_structure")
def text_structure(spark, sf_dir):
    return measured(spark, sf_dir, text.STRUCTURE_MEASURES)


@query("lexicon_counts")
def lexicon_counts(spark, sf_dir):
    return measured(spark, sf_dir, list(LEXICONS))


# --- profile tables -------------------------------------------------------


@query("dataset_profile")
def dataset_profile(spark, sf_dir):
    rows = modeling(
        spark, sf_dir, "product", "issue", "company", "state", "timely_response", "n_words"
    )
    # The cleaned table's own columns, without those of the expression index.
    return rounded(profile.dataset_profile(rows.drop(*text.STRUCTURE_MEASURES)))


def _frequency(column: str, *needs: str) -> Query:
    def run(spark, sf_dir):
        return rounded(profile.value_share(modeling(spark, sf_dir, *needs), column))

    return run


for _name, _column, _needs in (
    ("freq_product_group", "product_group", ("product",)),
    ("freq_product", "product", ("product",)),
    ("freq_issue", "issue", ("issue",)),
    ("freq_company", "company", ("company",)),
    ("freq_state", "state", ("state",)),
    ("freq_outcome", "response_outcome", ()),
):
    QUERIES[_name] = _frequency(_column, *_needs)


@query("monthly_profile")
def monthly_profile(spark, sf_dir):
    rows = modeling(spark, sf_dir, "timely_response", "n_words", "template_phrase_count")
    return rounded(profile.monthly_profile(rows))


@query("product_response")
def product_response(spark, sf_dir):
    rows = modeling(
        spark, sf_dir, "product", "timely_response", "n_words", "template_phrase_count"
    )
    return rounded(profile.product_response(rows))


@query("issue_response")
def issue_response(spark, sf_dir):
    rows = modeling(spark, sf_dir, "issue", "timely_response", "n_words", "template_phrase_count")
    return rounded(profile.issue_response(rows))


@query("pre_post_summary")
def pre_post_summary(spark, sf_dir):
    rows = modeling(spark, sf_dir, "timely_response", "n_words")
    return rounded(profile.compare_groups(rows))


@query("feature_correlation")
def feature_correlation(spark, sf_dir):
    return rounded(profile.correlate_with(modeling(spark, sf_dir, "n_words")))


# --- topics ---------------------------------------------------------------


def _stopped(spark, sf_dir) -> DataFrame:
    docs = spread(documents(spark, sf_dir), "doc_id")
    return vectors.narrative_words(docs).select("complaint_id", "kept_words")


def _terms(spark, sf_dir) -> DataFrame:
    return vectors.with_terms(_stopped(spark, sf_dir)).select("complaint_id", "terms")


@query("topic_tokens")
def topic_tokens(spark, sf_dir):
    return _stopped(spark, sf_dir).select(
        "complaint_id", F.posexplode("kept_words").alias("position", "token")
    )


@query("ngram_counts")
def ngram_counts(spark, sf_dir):
    return vectors.term_counts(_terms(spark, sf_dir))


@query("vocabulary")
def vocabulary(spark, sf_dir):
    return rounded(vectors.fit_vocabulary(_terms(spark, sf_dir)))


@query("tfidf_weights")
def tfidf_weights(spark, sf_dir):
    terms = vectors.with_terms(materialize(_stopped(spark, sf_dir), "words"))
    fitted = vectors.Vocabulary.of(vectors.fit_vocabulary(terms))
    weights = vectors.with_tfidf(terms, fitted)
    return rounded(vectors.long_weights(weights, "complaint_id", "tfidf", fitted))


def topic_model(
    spark: SparkSession, sf_dir: str, needs: Sequence[str] = (), keep: Sequence[str] = (), **options
) -> tuple[DataFrame, DataFrame, topics.TopicModel]:
    """Modeling rows (words and kept columns, written once), sparse vectors, fitted topics."""
    rows = vectors.narrative_words(modeling(spark, sf_dir, "consumer_narrative", *needs))
    rows = materialize(rows.select("complaint_id", "kept_words", *keep), "topic-rows")
    sparse, model = topics.fit_topics(rows, "complaint_id", **options)
    return rows, sparse, model


@query("nmf_topics")
def nmf_topics(spark, sf_dir):
    _, sparse, model = topic_model(spark, sf_dir)
    return model.weights(sparse, "complaint_id").select(
        "complaint_id", F.posexplode("weights").alias("topic", "weight")
    )


@query("topic_keywords")
def topic_keywords(spark, sf_dir):
    _, sparse, model = topic_model(spark, sf_dir)
    return model.keywords(sparse)


@query("dominant_topic")
def dominant_topic(spark, sf_dir):
    measures = list(profile.TOPIC_MEASURES.values())
    rows, _, model = topic_model(spark, sf_dir, ["timely_response", *measures], measures)
    return profile.topic_profile(model.label(rows))


def _with_given_topic(spark, sf_dir, *columns: str) -> DataFrame:
    """Modeling rows with a topic column taken from the data: the sub-issue."""
    return modeling(spark, sf_dir, "sub_issue", *columns).withColumn("topic", F.col("sub_issue"))


@query("topic_profile")
def topic_profile(spark, sf_dir):
    rows = _with_given_topic(spark, sf_dir, "timely_response", "n_words", "template_phrase_count")
    return rounded(profile.topic_profile(rows, "topic"))


KEYWORDS = 15


@query("topic_keywords_given")
def topic_keywords_given(spark, sf_dir):
    """Keyword lists with given weights: term uses per source of the documents."""
    docs = vectors.narrative_words(spread(documents(spark, sf_dir), "doc_id"))
    words = materialize(docs.select("raw_source", "kept_words"), "words")
    uses = vectors.leading_uses(words, "raw_source", "kept_words", KEYWORDS)
    return topics.keyword_lists(uses, "raw_source", KEYWORDS)


@query("dominant_topic_given")
def dominant_topic_given(spark, sf_dir):
    """Dominant topic with given weights: the lexicon with most hits per word."""
    rows = modeling(spark, sf_dir, "n_words")
    shares = [F.col(m) / F.greatest("n_words", F.lit(1)) for m in LEXICONS]
    weighted = rows.select("complaint_id", F.array(*shares).alias("weights"))
    return rounded(topics.dominant_topic(weighted))


# --- supervised models ----------------------------------------------------


def lexicon_score(rows: DataFrame) -> DataFrame:
    """A deterministic score in (0, 1): formal cues against distress cues."""
    formal = F.col("legal_term_count") + F.col("evidence_term_count")
    distress = F.col("anger_term_count") + F.col("hardship_term_count")
    score = (formal + 1).cast("double") / (formal + distress + F.col("n_sentences") + 2)
    return rows.select("complaint_id", F.col("any_relief").alias("label"), score.alias("score"))


def _scored(spark, sf_dir) -> DataFrame:
    return lexicon_score(modeling(spark, sf_dir, "n_words"))


@query("class_counts")
def class_counts(spark, sf_dir):
    rows = modeling(spark, sf_dir, "timely_response")
    relief = splitting.class_counts(rows, "any_relief").withColumn("target", F.lit("any_relief"))
    timely = splitting.class_counts(rows, "timely_binary").withColumn(
        "target", F.lit("timely_binary")
    )
    return splitting.gate_columns(relief.unionByName(timely), "target").select(
        "target", "class", "n", "status"
    )


@query("class_gate_many")
def class_gate_many(spark, sf_dir):
    """The gate on targets of one, two and many classes."""
    docs = table(spark, sf_dir, "documents")
    targets = {"one": F.lit(1), "two": F.col("doc_id") % 2, "ten": F.col("doc_id") % 10}
    counts = [
        splitting.class_counts(docs.select(value.alias(name)), name).withColumn("target", F.lit(name))
        for name, value in targets.items()
    ]
    return splitting.gate_columns(counts[0].union(counts[1]).union(counts[2]), "target", 5).select(
        "target", "class", "n", "status"
    )


def _inputs(spark, sf_dir) -> DataFrame:
    rows = modeling(spark, sf_dir, *MODEL_COLUMNS)
    return encoding.fill_inputs(rows, encoding.CATEGORICAL_FEATURES, profile.NUMERIC_FEATURES)


@query("model_inputs")
def model_inputs(spark, sf_dir):
    return rounded(
        _inputs(spark, sf_dir).select(
            "complaint_id", *encoding.CATEGORICAL_FEATURES, *profile.NUMERIC_FEATURES
        )
    )


@query("stratified_split")
def stratified_split(spark, sf_dir):
    rows = materialize(modeling(spark, sf_dir).select("complaint_id", "any_relief"), "targets")
    return splitting.stratified_split(rows, "any_relief", "complaint_id")


def _hashed_train(rows: DataFrame) -> DataFrame:
    return splitting.cv_folds(rows, "complaint_id", 4).filter("fold <> 0")


@query("rare_levels")
def rare_levels(spark, sf_dir):
    train = _hashed_train(_inputs(spark, sf_dir))
    return encoding.rare_levels(train, encoding.CATEGORICAL_FEATURES, min_freq=30)


@query("scaled_features")
def scaled_features(spark, sf_dir):
    rows = materialize(
        _inputs(spark, sf_dir).select("complaint_id", *profile.NUMERIC_FEATURES), "numbers"
    )
    return rounded(encoding.scale_by_sd(rows, _hashed_train(rows), profile.NUMERIC_FEATURES))


@query("class_weights")
def class_weights(spark, sf_dir):
    return rounded(splitting.balanced_weights(modeling(spark, sf_dir), "any_relief"))


@query("binary_metrics")
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(_scored(spark, sf_dir), threshold=0.3))


@query("class_report")
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(_scored(spark, sf_dir), threshold=0.3))


@query("roc_auc")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_scored(spark, sf_dir)))


@query("average_precision")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(_scored(spark, sf_dir)))


def response_model(spark: SparkSession, sf_dir: str, target: str = "any_relief"):
    rows = modeling(spark, sf_dir, "consumer_narrative", *MODEL_COLUMNS, batched=True)
    return models.fit_response_model(rows, target)


@query("response_model")
def response_model_metrics(spark, sf_dir):
    return response_model(spark, sf_dir).metrics()


@query("timely_model")
def timely_model_metrics(spark, sf_dir):
    fitted = response_model(spark, sf_dir, "timely_binary")
    if isinstance(fitted, dict):
        return spark.createDataFrame(
            [(fitted["target"], fitted["status"], str(fitted["class_counts"]))],
            "target string, status string, class_counts string",
        )
    return fitted.metrics()


@query("response_gradient")
def response_gradient(spark, sf_dir):
    """Is the loss flat at the fitted coefficients? One row per feature."""
    fitted = response_model(spark, sf_dir)
    flat = F.abs("gradient") <= fitted.model.scale * 1e-4
    return fitted.gradient().select("feature", flat.alias("settled"))


def _one_number_model(spark: SparkSession, sf_dir: str):
    rows = modeling(spark, sf_dir, "n_words").select(
        "complaint_id", F.col("any_relief").alias("label"), (F.col("n_words") / 100.0).alias("x")
    )
    rows = materialize(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows), "one-number")
    return rows, models.fit_logistic(rows, tol=1e-9)


@query("logistic_scores")
def logistic_scores(spark, sf_dir):
    """The logistic solver on one number, which SQL can solve too."""
    rows, fitted = _one_number_model(spark, sf_dir)
    scored = fitted.score(rows, "complaint_id").withColumns(
        {"coef": F.lit(float(fitted.coefficients[0])), "intercept": F.lit(fitted.intercept)}
    )
    return rounded(scored)


@query("top_features")
def top_features(spark, sf_dir):
    return response_model(spark, sf_dir).top_features()


@query("top_features_given")
def top_features_given(spark, sf_dir):
    """Top features with given coefficients: the correlations with relief."""
    found = profile.correlate_with(modeling(spark, sf_dir, "n_words")).collect()
    names = [r["feature"] for r in found]
    coefficients = [r["correlation"] or 0.0 for r in found]
    return rounded(models.top_features(names, coefficients, spark.range(0), n=6))


# --- expression shift -----------------------------------------------------


@query("yearly_counts")
def yearly_counts(spark, sf_dir):
    return shift.yearly_counts(modeling(spark, sf_dir))


@query("period_share")
def period_share(spark, sf_dir):
    return rounded(shift.period_share(modeling(spark, sf_dir)))


@query("product_shift")
def product_shift(spark, sf_dir):
    return rounded(shift.group_shift(modeling(spark, sf_dir, "product", "n_words")))


@query("topic_shift")
def topic_shift(spark, sf_dir):
    return rounded(shift.share_shift(_with_given_topic(spark, sf_dir), "topic"))


@query("product_topic")
def product_topic(spark, sf_dir):
    rows = _with_given_topic(spark, sf_dir, "product")
    return rounded(shift.cross_counts(rows, "product_group", "topic"))


@query("normalize_text")
def normalize_text(spark, sf_dir):
    return spread(documents(spark, sf_dir), "doc_id").select(
        "complaint_id", text.normalize_text(F.col("consumer_narrative")).alias("normalized")
    )


def _indexed(spark, sf_dir, *columns: str) -> DataFrame:
    rows = modeling(spark, sf_dir, "n_words", *columns)
    return shift.expression_index(shift.with_month_of_year(rows))


@query("expression_index")
def expression_index(spark, sf_dir):
    return rounded(_indexed(spark, sf_dir).select("complaint_id", "expression_index"))


@query("matched_neighbours")
def matched_neighbours(spark, sf_dir):
    rows = shift.with_month_of_year(modeling(spark, sf_dir, "product", *MATCHED))
    return shift.matched_neighbours(rows)


@query("local_shift")
def local_shift(spark, sf_dir):
    shifted = shift.local_shift(_indexed(spark, sf_dir, "product", *MATCHED))
    return rounded(shifted.select("complaint_id", "neighbours", "neighbour_mean", "local_shift"))


@query("time_split")
def time_split(spark, sf_dir):
    rows = modeling(spark, sf_dir).select("complaint_id", "complaint_month", "date_received")
    return splitting.time_split(rows, "date_received").drop("date_received")


@query("cv_folds")
def cv_folds(spark, sf_dir):
    return splitting.cv_folds(modeling(spark, sf_dir).select("complaint_id"), "complaint_id")


@query("calibration")
def calibration(spark, sf_dir):
    return rounded(metrics.calibration(_scored(spark, sf_dir)))


@query("isotonic_blocks")
def isotonic_blocks(spark, sf_dir):
    """Blocks of equal observed rate of the lexicon score."""
    fitted = isotonic.fit(_scored(spark, sf_dir))
    return fitted.blocks.select("first", "last", "n", "positives", "rate")


def _calibrated(scored: DataFrame, key: str = "complaint_id") -> DataFrame:
    """Reliability of a score on one half of the rows, before and after calibration on the other."""
    halves = materialize(splitting.cv_folds(scored.select(key, "label", "score"), key, 2), "scores")
    fitted = isotonic.fit(halves.filter("fold = 0"))
    return isotonic.reliability(fitted.apply(halves.filter("fold = 1")))


@query("calibrated_logistic")
def calibrated_logistic(spark, sf_dir):
    """Reliability of the logistic solver on one number, which SQL can solve too."""
    rows, fitted = _one_number_model(spark, sf_dir)
    return rounded(_calibrated(fitted.score(rows, "complaint_id")))


@query("response_calibration")
def response_calibration(spark, sf_dir):
    """Reliability of the response model's and the trees' scores on their test rows."""
    rows = gbt_rows(spark, sf_dir)
    scores = {"logistic": models.fit_response_model(rows, "any_relief").scored, "trees": gbt_scores(rows)}
    tables = [_calibrated(s).withColumn("model", F.lit(name)) for name, s in scores.items()]
    return rounded(tables[0].unionByName(tables[1]))


@query("slope_by_group")
def slope_by_group(spark, sf_dir):
    return rounded(models.slope_by_group(effect_residuals(spark, sf_dir), "product_group"))


@query("event_study")
def event_study(spark, sf_dir):
    return rounded(shift.event_study(_indexed(spark, sf_dir), CUTOFF))


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    return shift.embedding_clusters(vecs, "vec_id", "embedding", k=8)


@query("pca_index")
def pca_index(spark, sf_dir):
    rows = materialize(
        shift.with_densities(modeling(spark, sf_dir, "n_words")).select(
            "complaint_id", *shift.INDEX_DIMENSIONS
        ),
        "dims",
    )
    return rounded(shift.pca_index(rows, "complaint_id")[0])


def with_train_topics(labelled: DataFrame) -> DataFrame:
    """``labelled`` with the dominant topic of a factorization of its train rows."""
    words, model = topics.fit_topics(
        labelled.filter("part = 'train'").select("complaint_id", "kept_words"), "complaint_id", **TOPIC_FIT
    )
    found = model.label(labelled).drop("dominant_topic_weight")
    discard(words)
    return found.withColumn("dominant_topic", F.col("dominant_topic").cast("string"))


# Topics that are a model's input need not be settled to the last digit.
TOPIC_FIT = {"iters": 20, "tol": 1e-3}


def gbt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modeling rows with the columns of both models and of the local shift, measured and written once."""
    return materialize(modeling(spark, sf_dir, "consumer_narrative", *MODEL_COLUMNS, *MATCHED, batched=True), "model-rows")


def gbt_scores(rows: DataFrame) -> DataFrame:
    """Trees on text vector, structured fields, fitted topic and local shift of ``rows``; trained on the past."""
    shifted = shift.local_shift(shift.expression_index(shift.with_month_of_year(rows)))
    shifted = shifted.select("complaint_id", "local_shift")
    numbers = (*profile.NUMERIC_FEATURES, "local_shift")
    rows = rows.join(shifted, "complaint_id", "left")
    base = models.write_inputs(rows, "any_relief", numbers=numbers, keep=("date_received",))
    _, train, test = models.prepare_split(
        base,
        categories=(*encoding.CATEGORICAL_FEATURES, "dominant_topic"),
        numbers=numbers,
        split=lambda df: splitting.time_split(df, "date_received"),
        derive=with_train_topics,
    )
    return materialize(models.fit_gbt(train).score(test, "complaint_id"), "gbt")


@query("gbt_model")
def gbt_model(spark, sf_dir):
    scored = gbt_scores(gbt_rows(spark, sf_dir))
    ranked = metrics.rank_metrics(scored).select(F.struct("*")).scalar()
    return metrics.binary_metrics(scored).withColumn("roc_auc", ranked["roc_auc"])


TREE_FEATURES = ("n_sentences", "question_count", "exclamation_count", "digit_count")


@query("gbt_first_tree")
def gbt_first_tree(spark, sf_dir):
    """Splits, gains and values of one tree on four counts, each value its own bin."""
    rows = modeling(spark, sf_dir, *TREE_FEATURES).withColumn("label", F.col("any_relief"))
    vector = VectorAssembler(inputCols=list(TREE_FEATURES), outputCol="features")
    rows = materialize(vector.transform(rows).select("complaint_id", "label", "features"), "counts")
    boosted = models.fit_gbt(rows, trees=1, depth=2, bins=4096)
    return rounded(boosted.nodes(rows, TREE_FEATURES).drop("tree"))


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs, narrative included, of the earlier rows."""
    rows = modeling(spark, sf_dir, "consumer_narrative", *MODEL_COLUMNS, batched=True)
    base = models.write_inputs(rows, "any_relief", keep=("date_received",))
    return splitting.time_split(base, "date_received").filter("part = 'train'")


@query("cross_validation")
def cross_validation(spark, sf_dir):
    """Penalties compared by folds inside the earlier rows; each fold fits its own vocabulary, levels and scales."""
    found = models.cross_validate(_earlier(spark, sf_dir), "complaint_id", (0.0001, 0.01), k=3)
    return found.groupBy("penalty").agg(F.avg("roc_auc").alias("roc_auc"), F.min("n_features").alias("least_features"))


@query("fold_vocabulary")
def fold_vocabulary(spark, sf_dir):
    """The vocabulary of each fold's train rows, by subtraction."""
    rows = vectors.with_terms(splitting.cv_folds(_earlier(spark, sf_dir), "complaint_id", 3))
    return rounded(folds.fold_vocabularies(rows, 3))


@query("fold_levels")
def fold_levels(spark, sf_dir):
    rows = splitting.cv_folds(_earlier(spark, sf_dir), "complaint_id", 3)
    return folds.fold_levels(rows, 3, encoding.CATEGORICAL_FEATURES)


@query("fold_scales")
def fold_scales(spark, sf_dir):
    rows = splitting.cv_folds(_earlier(spark, sf_dir), "complaint_id", 3)
    return rounded(folds.fold_scales(rows, 3, profile.NUMERIC_FEATURES))


@query("response_attribution")
def response_attribution(spark, sf_dir):
    rows = modeling(spark, sf_dir, "consumer_narrative", *MODEL_COLUMNS, batched=True)
    encoder, train, test = models.prepare_split(models.write_inputs(rows, "any_relief"))
    fitted = models.fit_logistic(train)
    return models.linear_attribution(test, "features", encoder.names, fitted.coefficients)


@query("linear_attribution")
def linear_attribution(spark, sf_dir):
    """Attribution in the linear score whose coefficients are the correlations."""
    rows = materialize(
        modeling(spark, sf_dir, "n_words").select(*profile.NUMERIC_FEATURES, "any_relief"),
        "attribution",
    )
    found = profile.correlate_with(rows).collect()
    coefficients = {r["feature"]: r["correlation"] or 0.0 for r in found}
    names = list(profile.NUMERIC_FEATURES)
    vector = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    return rounded(
        models.linear_attribution(vector, "x", names, [coefficients[n] for n in names])
    )


EFFECT_CONTROLS = ("n_words", "n_sentences", "lexical_diversity", "uppercase_ratio")


def _shifted(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    return shift.local_shift(_indexed(spark, sf_dir, "product", *MATCHED), keep=keep)


def effect_residuals(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Residuals of relief and local shift after the controls."""
    rows = _shifted(spark, sf_dir, ("product_group", "state", "any_relief", *EFFECT_CONTROLS, *keep))
    rows = rows.filter("local_shift IS NOT NULL").withColumn(
        "any_relief", F.col("any_relief").cast("double")
    )
    return models.partial_linear(
        rows, "any_relief", "local_shift", EFFECT_CONTROLS, "complaint_id"
    )


@query("partial_linear")
def partial_linear(spark, sf_dir):
    return rounded(models.residual_slope(effect_residuals(spark, sf_dir)))


ABSORBED = ("product_group", "company", "state", "complaint_month")


@query("absorbed_means")
def absorbed_means(spark, sf_dir):
    """Means of the residuals of relief and length by level: none, once the levels are absorbed."""
    rows = modeling(spark, sf_dir, "product", "company", "state", "n_words").select(
        "complaint_id", *ABSORBED, F.col("any_relief").cast("double").alias("relief"), (F.col("n_words") / 100.0).alias("length")
    )
    left = absorption.absorb(materialize(rows, "effects-in"), ("relief", "length"), ABSORBED)
    means = absorption.group_means(left, ("relief", "length"), ABSORBED)
    return rounded(means.withColumns({c: F.abs(F.round(c, 5)) for c in ("relief", "length")}))


@query("partial_linear_absorbed")
def partial_linear_absorbed(spark, sf_dir):
    """The effect of the local shift, product, company, state and month absorbed, the controls cross-fitted."""
    columns = ("any_relief", "local_shift", *EFFECT_CONTROLS)
    rows = _shifted(spark, sf_dir, ("any_relief", *ABSORBED, *EFFECT_CONTROLS)).filter("local_shift IS NOT NULL")
    rows = rows.select("complaint_id", *ABSORBED, *[F.col(c).cast("double").alias(c) for c in columns])
    left = absorption.absorb(materialize(rows, "effects-in"), columns, ABSORBED)
    residuals = models.partial_linear(left, "any_relief", "local_shift", EFFECT_CONTROLS, "complaint_id")
    return rounded(models.residual_slope(residuals))


@query("effect_heterogeneity")
def effect_heterogeneity(spark, sf_dir):
    """The effect by product, company and state, errors clustered by month, drawn to each dimension's mean."""
    residuals = effect_residuals(spark, sf_dir, "company", "complaint_month")
    slopes = models.clustered_slopes(residuals, ("product_group", "company", "state"), "complaint_month")
    return rounded(models.shrunk_slopes(materialize(slopes, "slopes")))


@query("partial_linear_groups")
def partial_linear_groups(spark, sf_dir):
    return rounded(models.slope_by_group(effect_residuals(spark, sf_dir), "state"))
