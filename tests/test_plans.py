"""What the plans of the registered queries must and must not contain."""

import re

import numpy as np
import pytest

from redressa import session
from redressa.operators import folds, shift, topics, vectors
from redressa.plans import queries
from redressa.plans.queries import MATCHED, QUERIES, modeling
from redressa.sources.writers import write_table

SF_DIR = "/root/testdata/sf0.001"
# These start jobs or run Python batches by nature; the rest is planned only.
EAGER = {
    "api_hits",
    "cross_validation",
    "csv_mixed_headers",
    "parquet_mixed_columns",
    "sink_round_trip",
    "slope_by_group",
    "source_copy",
    "average_precision",
    "csv_scan",
    "dominant_topic",
    "effect_heterogeneity",
    "embedding_clusters",
    "gbt_model",
    "linear_attribution",
    "nmf_topics",
    "partial_linear",
    "partial_linear_groups",
    "pca_index",
    "response_attribution",
    "response_calibration",
    "response_model",
    "roc_auc",
    "tfidf_weights",
    "timely_model",
    "top_features",
    "top_features_given",
    "topic_keywords",
}


def plan(spark, name):
    return executed(QUERIES[name](spark, SF_DIR))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", text)


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "freq_state")
    assert "text" in text  # a blank narrative decides on modeling rows
    assert "l_shipdate" not in text and "p_type" not in text and "quality" not in text
    assert "o_totalprice" not in text


def test_text_is_not_shuffled_for_its_measures(spark):
    """Past the first spreading of a small input, exchanges carry numbers only."""
    text = plan(spark, "monthly_profile")
    above = text.split("REPARTITION_BY_NUM")[0]
    dedup = above[above.index("WindowGroupLimit") :]
    assert "regexp_extract_all" in dedup


@pytest.mark.parametrize("name", ["dedup_first", "freq_company"])
def test_groups_are_trimmed_before_the_shuffle(spark, name):
    text = plan(spark, name)
    wanted = {"dedup_first": "complaint_id", "freq_company": "variable"}
    assert re.search(rf"WindowGroupLimit \[{wanted[name]}#.*Partial", text)


def test_neighbour_lists_are_trimmed_before_the_shuffle(spark):
    rows = shift.with_month_of_year(modeling(spark, SF_DIR, "product", *MATCHED))
    text = executed(shift.cell_neighbours(rows, "product_group", shift.MATCH_KEYS, 5))
    assert re.search(r"WindowGroupLimit \[_group#.*Partial", text)


def test_a_hot_cell_can_be_split(spark):
    """Both sides of the join by cell are plain exchanges of a scan, or one is broadcast."""
    text = plan(spark, "matched_neighbours")
    join = text[text.index("Join") :]
    assert "Window" not in join and "Aggregate" not in join


def test_topics_are_labelled_without_an_exchange(spark):
    rows = spark.createDataFrame([(None, ["late", "fee"], "long text")], "id string, kept_words array<string>, t string")
    model = topics.TopicModel(np.ones((2, 1)), [], vectors.Vocabulary(["fee"], [1.0]))
    text = executed(model.label(rows))
    assert "Exchange" not in text and model.label(rows).first()["t"] == "long text"


def test_filters_reach_the_scan(spark):
    text = plan(spark, "source_manifest")
    assert "EqualTo(toxic,1)" in text


def test_terms_of_all_folds_are_shuffled_once(spark):
    df = spark.createDataFrame([(f, ["x", "y"]) for f in (0, 1, 2)], "fold int, terms array<string>")
    plan = folds.fold_vocabularies(df, 3, min_df=1)._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"hashpartitioning\(term#\d+, ", plan))) == 1
    assert not re.search(r"hashpartitioning\(term#\d+, fold#", plan)


def test_a_scan_task_reads_a_bounded_part(spark):
    name = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(name)
    for given, wanted in (("134217728b", session.SCAN_BYTES), (str(1 << 20), 1 << 20)):
        spark.conf.set(name, given)
        session.configure(spark)
        assert spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() == wanted
    spark.conf.set(name, kept)


def test_no_task_writes_a_csv_of_all_documents(spark, monkeypatch, tmp_path):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a \"text\", ', id) AS text", "'s' AS source")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    monkeypatch.setattr(queries, "CSV_BYTES", 1000)
    monkeypatch.setattr(queries, "write_table", lambda df, *args: written.append(df) or write_table(df, *args))
    found = QUERIES["csv_blocks"](spark, str(tmp_path))
    assert written[0].rdd.getNumPartitions() > 1
    assert found.count() == found.select("complaint_id").distinct().count() == 40


def test_orders_are_not_shuffled_for_their_supplier(spark):
    plan = QUERIES["freq_company"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"s_suppkey#\d+L? >= -9", plan)


def test_a_carried_narrative_is_measured_after_the_dedup(spark):
    plan = modeling(spark, SF_DIR, "consumer_narrative", "n_words").select("consumer_narrative", "n_words")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # Words are found above the dedup's window, in rows that its filter has left.
    assert text.index("regexp_extract_all") < text.index("Window")
    assert "regexp_extract_all" not in text[text.index("Window") :]
