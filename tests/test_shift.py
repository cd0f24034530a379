"""Shift measures; matched neighbours against brute force with a hot group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redressa.operators import shift

KEYS = ["issue", "company", "state", "month_of_year"]


def complaints(n=600, seed=2):
    """Half of the rows share one product, and half of those one company."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        product = "hot" if rng.random() < 0.5 else rng.choice(["p1", "p2", None, "only_after"])
        after = 1 if product == "only_after" else int(rng.random() < 0.5)
        rows.append(
            (
                f"{i:04d}",
                product,
                rng.choice(["i1", "i2", None]),
                "big" if rng.random() < 0.5 else rng.choice(["c1", "c2", "c3", None]),
                rng.choice(["FL", "CA", "TX", None, ""]),
                rng.randint(1, 12) if rng.random() < 0.9 else None,
                after,
                round(rng.random(), 3),
            )
        )
    return rows


SCHEMA = (
    "complaint_id string, product_group string, issue string, company string, state string,"
    " month_of_year int, post_cutoff int, e double"
)


def brute_force(rows, k):
    out = {}
    for a in rows:
        if a[6] != 1:
            continue
        ranked = sorted(
            (-sum(x is not None and x == y for x, y in zip(a[2:6], b[2:6])), b[0], b[7])
            for b in rows
            if b[6] == 0 and a[1] is not None and b[1] == a[1]
        )[:k]
        if ranked:
            out[a[0]] = [(i, -m, e) for m, i, e in ranked]
    return out


@pytest.mark.parametrize("k", [1, 5, 400])
def test_neighbours_equal_brute_force(spark, k):
    rows = complaints()
    want = brute_force(rows, k)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in shift.matched_neighbours(df, keys=KEYS, k=k).collect():
        got.setdefault(r["complaint_id"], []).append((r["rank"], r["neighbour_id"], r["matches"]))
    assert {key: [v[1:] for v in sorted(vs)] for key, vs in got.items()} == {
        key: [v[:2] for v in vs] for key, vs in want.items()
    }
    shifted = shift.local_shift(df, "e", keys=KEYS, k=k).collect()
    assert len(shifted) == sum(r[6] == 1 for r in rows)
    by_id = {r[0]: r for r in rows}
    for r in shifted:
        if r["complaint_id"] not in want:
            assert (r["neighbours"], r["local_shift"]) == (0, None)
            continue
        mean = np.mean([e for _, _, e in want[r["complaint_id"]]])
        assert r["local_shift"] == pytest.approx(by_id[r["complaint_id"]][7] - mean)
        assert r["neighbours"] == len(want[r["complaint_id"]])


def test_index_ignores_constant_dimensions(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    got = [r["expression_index"] for r in shift.expression_index(df, {"a": ["a"], "b": ["b"]}).orderBy("a").collect()]
    assert got == [-0.5, 0.5]


def test_expression_index_weighs_dimensions_not_measures(spark):
    rows = [(0.0, 0.0, 4.0), (2.0, 8.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = shift.expression_index(df, {"one": ["a"], "two": ["b", "c"]}).orderBy("a").collect()
    assert [r["expression_index"] for r in got] == [-0.75, 0.75]


def test_pca_index(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=200)
    x = np.column_stack([base + 0.1 * rng.normal(size=200), 5 * base, rng.normal(size=200)])
    rows = [(i, *(float(v) for v in x[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    scored, weights = shift.pca_index(df, "id", ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.svd(z, full_matrices=False)[2][0]
    want = want * np.sign(want.sum())
    assert weights == pytest.approx(list(want), abs=1e-6)
    got = {r["id"]: r["pca_index"] for r in scored.collect()}
    assert [got[i] for i in range(200)] == pytest.approx(list(z @ want), abs=1e-6)


def test_period_and_topic_shares(spark):
    df = spark.createDataFrame(
        [("t", 0, 1), ("t", 1, 1), ("u", 1, 0), (None, 1, 0)], "topic string, post_cutoff int, any_relief int"
    )
    row = shift.period_share(df).first()
    assert (row["n_before"], row["n_after"], row["share_after"]) == (1, 3, 0.75)
    assert row["points"] == pytest.approx((1 / 3 - 1) * 100)
    got = {r["topic"]: r["points"] for r in shift.share_shift(df, "topic").collect()}
    assert got == {"t": pytest.approx(-50.0), "u": pytest.approx(50.0)}
    cells = {(r["topic"], r["any_relief"]): (r["n"], r["share"]) for r in shift.cross_counts(df, "topic", "any_relief").collect()}
    assert cells == {("t", 1): (2, 1.0), ("u", 0): (1, 1.0)}


def test_event_study_counts_months_from_the_cutoff(spark):
    df = spark.createDataFrame([("2022-10-31", 1.0), ("2022-11-01", 2.0), ("2023-01-15", 3.0), (None, 9.0)], "d string, v double")
    df = df.withColumn("d", F.col("d").cast("date"))
    got = [tuple(r) for r in shift.event_study(df, "2022-11-30", "v", "d").collect()]
    assert got == [(-1, 1, 1.0), (0, 1, 2.0), (2, 1, 3.0)]


def test_clusters_separate_distant_vectors(spark):
    rows = [(i, [float(i % 2 * 10), 0.1 * i]) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: r["cluster"] for r in shift.embedding_clusters(df, "id", "v", k=2).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == 1
    assert got[0] != got[1]
