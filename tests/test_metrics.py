"""Score metrics, running totals and splits."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from redressa.operators import metrics, splitting
from redressa.operators.running import running_totals

# Two published class reports (class: precision, recall, support) and accuracies.
PUBLISHED = [
    (
        {"0": (0.8429042904290429, 0.6828877005347593, 5610), "1": (0.41112214498510424, 0.6349693251533742, 1956)},
        0.6704996034892942,
        0.49909584086799275,
    ),
]


def scored(spark, pairs):
    return spark.createDataFrame(
        [(i, y, float(s)) for i, (s, y) in enumerate(pairs)], "id int, label int, score double"
    )


def test_areas_with_ties(spark):
    df = scored(spark, zip([0.9, 0.8, 0.7, 0.6, 0.6, 0.2], [1, 0, 1, 1, 0, 0]))
    assert metrics.average_precision(df).first()[0] == pytest.approx(0.755556, abs=1e-6)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(0.722222, abs=1e-6)


def test_areas_do_not_depend_on_the_ranges(spark):
    rng = random.Random(3)
    pairs = [(round(rng.random() ** 8, 4), int(rng.random() < 0.3)) for _ in range(3000)]
    df = scored(spark, pairs)
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    won = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    want = won / (len(pos) * len(neg))
    for rows in (50, 4_000_000):
        assert metrics.roc_auc(df, rows).first()[0] == pytest.approx(want, abs=1e-12)
    a, b = (metrics.average_precision(df, r).first()[0] for r in (50, 4_000_000))
    assert a == pytest.approx(b, abs=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    df = spark.range(1000).select((F.col("id") / 7).alias("x"), (F.col("id") % 5).alias("n"))
    rows = running_totals(df, "x", ["n"], descending, rows_per_range=64).collect()
    total = 0
    for r in sorted(rows, key=lambda r: -r["x"] if descending else r["x"]):
        total += r["n"]
        assert r["n_upto"] == total


def test_one_class_has_no_auc(spark):
    df = scored(spark, [(0.1, 1), (0.2, 1)])
    assert metrics.roc_auc(df).first()[0] is None
    assert metrics.average_precision(df).first()[0] == 1.0


@pytest.mark.parametrize("report, accuracy, f1", PUBLISHED)
def test_published_report_follows_from_its_confusion(spark, report, accuracy, f1):
    (_, r0, n0), (_, r1, n1) = report["0"], report["1"]
    tn, tp = round(r0 * n0), round(r1 * n1)
    pairs = [(0.1, 0)] * tn + [(0.9, 0)] * (n0 - tn) + [(0.9, 1)] * tp + [(0.1, 1)] * (n1 - tp)
    df = scored(spark, pairs)
    row = metrics.binary_metrics(df).first()
    assert row["accuracy"] == pytest.approx(accuracy, abs=1e-12)
    assert row["f1"] == pytest.approx(f1, abs=1e-12)
    got = {r["class"]: r for r in metrics.class_report(df).collect()}
    for name, (precision, recall, support) in report.items():
        assert got[name]["precision"] == pytest.approx(precision, abs=1e-12)
        assert got[name]["recall"] == pytest.approx(recall, abs=1e-12)
        assert got[name]["support"] == support
    assert got["weighted avg"]["recall"] == pytest.approx(accuracy, abs=1e-12)


def test_quotas_of_the_published_split(spark):
    counts = spark.createDataFrame([(0, 22439), (1, 7824)], "class int, n long")
    got = {r["class"]: r["quota"] for r in splitting.class_quotas(counts, 0.25).collect()}
    assert got == {0: 5610, 1: 1956}


def test_split_takes_the_smallest_hashes(spark):
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("key"), (F.col("id") % 10 < 1).cast("int").alias("y")
    )
    df = df.unionByName(df.limit(1).withColumns({"key": F.lit("none"), "y": F.lit(None).cast("int")}))
    parts = splitting.stratified_split(df, "y", "key", seed=7).withColumn(
        "h", splitting.seeded_hash("key", 7)
    )
    rows = parts.collect()
    assert len(rows) == 4000
    for y, size in ((0, 3600), (1, 400)):
        ranked = sorted((r["h"], r["part"]) for r in rows if r["y"] == y)
        quota = size // 4
        assert [p for _, p in ranked] == ["test"] * quota + ["train"] * (size - quota)


def test_gate_and_weights(spark):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10 + [(None,)] * 5, "y int")
    assert splitting.class_gate(df, "y")["status"] == "skipped"
    gate = splitting.class_gate(df, "y", min_class=10)
    assert gate == {"target": "y", "status": "fit", "class_counts": {"0": 90, "1": 10}}
    got = {r["class"]: r["weight"] for r in splitting.balanced_weights(df, "y").collect()}
    assert got == {0: pytest.approx(100 / 180), 1: pytest.approx(5.0)}


def test_time_split_and_folds(spark):
    df = spark.range(100).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("d"),
        F.col("id").cast("string").alias("k"),
    )
    parts = {p: [r["d"] for r in rows] for p, rows in _by(splitting.time_split(df, "d"), "part")}
    assert max(parts["train"]) < min(parts["test"])
    assert len(parts["train"]) == math.ceil(0.75 * 100 / 2) * 2
    folds = [r["fold"] for r in splitting.cv_folds(df, "k", 4).collect()]
    assert set(folds) == {0, 1, 2, 3}


def _by(df, column):
    rows = sorted(df.collect(), key=lambda r: r[column])
    return [(k, list(g)) for k, g in itertools.groupby(rows, key=lambda r: r[column])]


def test_calibration_bins(spark):
    df = scored(spark, [(0.0, 0), (0.05, 1), (0.95, 1), (1.0, 1)])
    rows = {r["bin"]: r for r in metrics.calibration(df).collect()}
    assert (rows[0]["n"], rows[9]["n"]) == (2, 2)
    assert (rows[0]["positive_rate"], rows[9]["mean_score"]) == (0.5, pytest.approx(0.975))
