"""The pipeline's stages, one after the other, and the registered queries."""

import pyarrow.parquet as pq

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[3] < counts[2] or counts[2] < counts[1]
    packed = pq.read_table(str(tmp_path / "best_fit_packing")).to_pandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    kept = pq.read_table(str(tmp_path / "benchmark_decontamination")).to_pandas()
    assert set(packed["doc_id"]) == set(kept["doc_id"])


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).count() == 0


def test_one_query_for_each_operator():
    numbers = sorted(int(q[2:].split("_")[0]) for q in entry.queries() if q.startswith("op") and q[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
