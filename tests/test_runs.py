"""The whole run from CSV and Parquet sources to the summary."""

import json
from types import SimpleNamespace

import pandas as pd
import pytest

import redressa.session as session
from redressa.plans.runs import Source, run_all
from redressa.sources.complaint_view import complaint_rows


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    rows = complaint_rows(spark, "/root/testdata/sf0.001").drop("has_narrative").toPandas()
    rows = rows[[c for c in rows.columns if not c.startswith("n_")]].iloc[:, 1:20]
    rows["date_received"] = rows["date_received"].dt.strftime("%m/%d/%Y")
    rows["date_sent_to_company"] = rows["date_sent_to_company"].dt.strftime("%Y-%m-%d %H:%M:%S")
    main = rows[rows["raw_source"] != "replay"].rename(
        columns={"consumer_narrative": "Consumer complaint narrative", "timely_response": "Timely response?"}
    )
    main.drop(columns="raw_source").to_csv(root / "main.csv", index=False)
    rows[rows["raw_source"] == "replay"].to_parquet(root / "replay.parquet")
    sources = [
        Source("main", str(root / "main.csv"), "csv"),
        Source("replay", str(root / "replay.parquet"), "parquet"),
    ]
    options = {"tol": 1e-3, "k": 3}
    summary = run_all(spark, sources, str(root / "out"), "1998-06-01", topic_options=options)
    return root / "out", summary, len(rows), len(main)


def read_csv(path):
    return pd.concat(pd.read_csv(p) for p in sorted(path.glob("part-*.csv")))


def test_counts_and_profile(spark, done):
    out, summary, n_raw, n_main = done
    assert summary["profile"]["columns"] == 53
    meta = json.loads(
        "\n".join(r[0] for r in spark.read.text(str(out / "clean/cleaning_metadata.json"), wholetext=True).collect())
    )
    assert (meta["raw_rows"], meta["deduplicated_rows"]) == (n_raw, n_main)
    assert meta["modeling_rows"] == summary["profile"]["rows"]
    clean = spark.read.parquet(str(out / "clean/complaints"))
    assert clean.filter("consumer_narrative LIKE 'COPY %'").count() == 0
    assert clean.filter("raw_source = 'main'").count() == n_main


def test_tables(done):
    out, summary, _, _ = done
    shares = read_csv(out / "tables/frequencies")
    assert set(shares["variable"]) == {"product_group", "product", "issue", "company", "state", "response_outcome"}
    assert shares[shares["variable"] == "response_outcome"]["share"].sum() == pytest.approx(1.0)
    topics = read_csv(out / "tables/topic_response_rates")
    assert topics["n"].sum() == summary["profile"]["rows"]
    assert len(read_csv(out / "tables/topic_keywords")) == 3
    assert len(read_csv(out / "tables/feature_correlations")) == 20
    assert len(read_csv(out / "clean/feature_dictionary")) == 14


def test_models(done):
    out, summary, _, _ = done
    relief, timely = (summary["models"][t] for t in ("any_relief", "timely_binary"))
    assert relief["status"] == "fit"
    assert relief["n_train"] + relief["n_test"] == summary["profile"]["rows"]
    assert 0 <= relief["roc_auc"] <= 1
    assert timely["status"] == "skipped"
    assert len(read_csv(out / "tables/model_top_features_any_relief")) == 80


def session_with(folder, master):
    """A session's two answers that choose the scratch folder."""
    conf = SimpleNamespace(get=lambda name, default=None: folder or default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_scratch_folder_comes_from_the_session():
    assert session.scratch_dir(session_with("hdfs://shared/x/", "yarn")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(session_with(None, "yarn"))
    assert session.scratch_dir(session_with(None, "local[2]"))


def test_materialized_frames_are_read_from_the_scratch_folder(spark):
    df = session.materialize(spark.range(3), "t")
    assert df.count() == 3
    assert all(f"{session.scratch_dir(spark)}/redressa-t-" in f for f in df.inputFiles())


def test_small_inputs_are_spread_on_request(spark):
    df, before = spark.range(100).toDF("doc_id"), spark.conf.get(session.SOURCE_TASKS)
    try:
        spark.conf.set(session.SOURCE_TASKS, "5")
        assert session.spread(df, "doc_id").rdd.getNumPartitions() == 5
        spark.conf.unset(session.SOURCE_TASKS)
        assert session.spread(df, "doc_id") is df
    finally:
        spark.conf.set(session.SOURCE_TASKS, before)


def test_scratch_is_removed(spark, tmp_path):
    df = spark.range(3).toDF("id")
    one, two = session.materialize(df, "one"), session.materialize(df, "two")
    session.discard(one)
    assert not session.path_exists(spark, one._scratch) and two.count() == 3
    session.release(spark)
    assert not session.path_exists(spark, two._scratch)
