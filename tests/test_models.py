"""Encoding and models against numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from redressa.operators import blocks, encoding, models


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1] - 1)))).astype(int)
    rows = [(str(i), int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "complaint_id string, label int, x array<double>")
    return x, y, df.withColumn("features", array_to_vector("x")).drop("x")


def newton(x, y, c=1.0):
    """Balanced L2 logistic regression, the intercept penalized like the rest."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    z = np.column_stack([x, np.ones(n)])
    penalty = np.eye(z.shape[1]) / c
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (weight * (p - y)) + penalty @ beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        beta -= np.linalg.solve(hess, grad)
    return beta


def test_logistic_equals_newton(spark):
    x, y, df = frame(spark)
    beta = newton(x, y)
    model = models.fit_logistic(df, tol=1e-8)
    assert model.coefficients == pytest.approx(beta[:3], abs=1e-6)
    assert model.intercept == pytest.approx(beta[3], abs=1e-6)
    scores = {r["complaint_id"]: r["score"] for r in model.score(df, "complaint_id").collect()}
    want = 1 / (1 + np.exp(-(x @ beta[:3] + beta[3])))
    assert [scores[str(i)] for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-6)


def test_logistic_with_more_features_than_rows_and_few_passes(spark, monkeypatch):
    """Separable rows, sparse columns, several blocks and slots of sums; the gradient is that of numpy."""
    monkeypatch.setattr(blocks, "ROWS", 32)
    monkeypatch.setattr(blocks, "SUMS_BYTES", 1)
    rng = np.random.default_rng(3)
    x = (rng.random((300, 500)) < 0.03) * rng.random((300, 500))
    x[:, -2:] = rng.normal(size=(300, 2)) * 3 + 5
    y = (rng.random(300) < 0.3).astype(int)
    rows = [(str(i), int(y[i]), Vectors.sparse(500, [(int(j), float(v)) for j, v in enumerate(x[i]) if v])) for i in range(300)]
    df = spark.createDataFrame(rows, ["complaint_id", "label", "features"])
    model = models.fit_logistic(df, tol=1e-8)
    beta = newton(x, y)
    assert np.append(model.coefficients, model.intercept) == pytest.approx(beta, abs=1e-5)
    assert model.passes < 40


def test_logistic_of_empty_vectors_and_one_column(spark):
    rows = [(str(i), i % 2, Vectors.sparse(1, [])) for i in range(6)]
    model = models.fit_logistic(spark.createDataFrame(rows, ["complaint_id", "label", "features"]))
    assert model.coefficients.tolist() == [0.0] and model.intercept == 0.0


def test_attribution(spark):
    rows = [(1, [0.0, 2.0, 1.0]), (2, [4.0, 0.0, 1.0]), (3, [0.0, 0.0, 1.0])]
    x = np.array([r[1] for r in rows])
    df = spark.createDataFrame(rows, "id int, x array<double>").withColumn("f", array_to_vector("x"))
    coef = [0.5, -2.0, 3.0]
    want = np.abs(np.array(coef) * (x - x.mean(0))).mean(0)
    out = models.linear_attribution(df, "f", ["a", "b", "c"], coef).collect()
    got = {r["feature"]: r["mean_abs_contribution"] for r in out}
    assert [got[n] for n in "abc"] == pytest.approx(list(want))


def test_top_features(spark):
    df = spark.range(1)
    rows = models.top_features(["a", "b", "c"], [0.1, -3.0, 2.0], df, n=2).collect()
    assert [(r["feature"], r["direction"]) for r in rows] == [
        ("c", "positive"),
        ("a", "positive"),
        ("b", "negative"),
        ("a", "negative"),
    ]
    assert rows[2]["abs_coef"] == 3.0


def test_fill_inputs(spark):
    df = spark.createDataFrame([(None, None), ("x", "1.5"), ("y", "bad")], "c string, n string")
    got = [tuple(r) for r in encoding.fill_inputs(df, ["c"], ["n"]).collect()]
    assert got == [("Missing", 0.0), ("x", 1.5), ("y", 0.0)]


def test_encoder_pools_rare_levels_and_zeroes_unseen_ones(spark):
    rows = [("a", 1.0, 7.0)] * 3 + [("b", 3.0, 7.0)] * 2 + [("r", 5.0, 7.0), ("s", 5.0, 7.0)]
    train = spark.createDataFrame(rows, "c string, n double, constant double")
    encoder = encoding.Encoder.fit(train, None, ["c"], ["n", "constant"], min_freq=2)
    assert encoder.names == ["c=a", "c=b", "c=infrequent", "n", "constant"]
    sd = np.std([r[1] for r in rows])
    test = spark.createDataFrame(
        [("a", 2.0, 7.0), ("s", 0.0, 7.0), ("new", 1.0, 7.0)], "c string, n double, constant double"
    )
    got = [r[0] for r in encoder.transform(test).select(vector_to_array("features")).collect()]
    want = [[1, 0, 0, 2 / sd, 7], [0, 0, 1, 0, 7], [0, 0, 0, 1 / sd, 7]]
    assert np.array(got) == pytest.approx(np.array(want))


def test_partial_linear_recovers_the_slope(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(size=(n, 2))
    t = x @ [0.7, -0.2] + rng.normal(size=n)
    y = 1.5 * t + x @ [2.0, 1.0] + rng.normal(size=n)
    rows = [(str(i), "g" + str(i % 2), *(float(v) for v in (y[i], t[i], *x[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, g string, y double, t double, a double, b double")
    residuals = models.partial_linear(df, "y", "t", ["a", "b"], "k", folds=3)
    row = models.residual_slope(residuals).first()
    assert row["n"] == n
    assert row["slope"] == pytest.approx(1.5, abs=0.08)
    assert 0.01 < row["std_error"] < 0.03
    groups = models.slope_by_group(residuals, "g").collect()
    assert [r["n"] for r in groups] == [n // 2] * 2
    assert all(r["slope"] == pytest.approx(1.5, abs=0.15) for r in groups)


def test_constant_treatment_has_no_slope(spark):
    df = spark.createDataFrame(
        [("g", 1.0, 2.0), ("g", 0.0, 2.0)],
        "g string, outcome_residual double, treatment_residual double",
    )
    assert models.slope_by_group(df, "g").first()["slope"] is None


def test_skipped_target(spark):
    df = spark.createDataFrame([("1", 0), ("2", 1)], "complaint_id string, any_relief int")
    record = models.fit_response_model(df, "any_relief", text=None, categories=(), numbers=())
    assert record["status"] == "skipped" and record["class_counts"] == {"0": 1, "1": 1}


def test_cross_validation_leaves_the_fold_out(spark):
    """Words that tell the label only inside one fold are in no other fold's score."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(300):
        x = rng.normal(size=2)
        y = int(rng.random() < 1 / (1 + np.exp(-2 * x[0])))
        words = [rng.choice(["alpha", "beta", "gamma"]) for _ in range(6)] + (["good"] if y and i % 2 else [])
        rows.append((str(i), y, "ab"[i % 2], *(float(v) for v in x), words))
    base = spark.createDataFrame(rows, "complaint_id string, label int, c string, a double, b double, kept_words array<string>")
    found = models.cross_validate(base, "complaint_id", [0.001, 0.1], k=3, categories=["c"], numbers=["a", "b"]).collect()
    assert [(r["penalty"], r["fold"]) for r in found] == [(p, f) for f in range(3) for p in (0.001, 0.1)]
    assert all(0.6 < r["roc_auc"] <= 1.0 and r["n_features"] > 4 for r in found)
    plain = models.cross_validate(base.drop("kept_words"), "complaint_id", [0.1], k=2, categories=["c"], numbers=["a", "b"])
    assert {r["n_features"] for r in plain.collect()} == {4}


def test_trees_on_encoded_rows(spark):
    _, _, df = frame(spark)
    model = models.fit_gbt(df, trees=3, depth=2)
    assert model.score(df, "complaint_id").count() == 400


def test_clustered_and_shrunk_slopes(spark):
    rng = np.random.default_rng(11)
    rows, groups = [], {"a": 0.4, "b": -0.2, "c": 1.0, "few": 0.0, "flat": 0.0}
    for group, slope in groups.items():
        for i in range(9 if group == "few" else 120):
            month = f"m{i % (3 if group == 'few' else 12)}"
            t = 0.7 if group == "flat" else float(rng.normal() + 2)
            rows.append((group, None if month == "m1" else month, t, float(slope * t + rng.normal() + 1)))
    rows.append((None, "m0", 1.0, 1.0))
    df = spark.createDataFrame(rows, "g string, month string, treatment_residual double, outcome_residual double")
    slopes = models.clustered_slopes(df, ["g"], "month")
    got = {r["level"]: r for r in models.shrunk_slopes(slopes).collect()}
    assert set(got) == set(groups)
    assert got["flat"]["slope"] is None and got["few"]["std_error"] is None
    fits = {}
    for group in ("a", "b", "c", "few"):
        own = [r for r in rows if r[0] == group]
        t, y = (np.array([r[i] for r in own]) for i in (2, 3))
        t, y = t - t.mean(), y - y.mean()
        b = (t @ y) / (t @ t)
        scores = {}
        for r, s in zip(own, t * (y - b * t), strict=True):
            scores[r[1]] = scores.get(r[1], 0.0) + s
        k = len(scores)
        error = np.sqrt(sum(s * s for s in scores.values()) * k / (k - 1)) / (t @ t)
        assert got[group]["slope"] == pytest.approx(b, abs=1e-9)
        assert (got[group]["n"], got[group]["clusters"]) == (len(own), k)
        if group != "few":
            assert got[group]["std_error"] == pytest.approx(error, abs=1e-9)
            fits[group] = (b, error**2)
    b, v = (np.array(x) for x in zip(*fits.values(), strict=True))
    w = 1 / v
    centre = (w @ b) / w.sum()
    tau2 = max(0.0, (w @ (b - centre) ** 2 - 2) / (w.sum() - (w @ w) / w.sum()))
    assert tau2 > 0
    for (group, (slope, error)) in fits.items():
        assert got[group]["shrunk_slope"] == pytest.approx((slope * tau2 + centre * error) / (tau2 + error), abs=1e-9)
        assert abs(got[group]["shrunk_slope"] - centre) < abs(slope - centre)
        assert got[group]["shrunk_error"] == pytest.approx(np.sqrt(tau2 * error / (tau2 + error)), abs=1e-9)
    for group in ("few", "flat"):
        assert got[group]["shrunk_slope"] == pytest.approx(centre, abs=1e-9)
        assert got[group]["shrunk_error"] == pytest.approx(np.sqrt(tau2), abs=1e-9)


def test_gradient_counts_each_train_row_once_when_keys_repeat_or_are_null(spark):
    x, y, df = frame(spark)
    keys = F.when(F.col("complaint_id") % 5 == 0, F.lit(None)).otherwise((F.col("complaint_id") % 7).cast("string"))
    train = df.withColumn("complaint_id", keys)
    beta = np.array([0.5, -0.25, 0.1, -0.2])
    fixed = models.Logistic(beta[:3], float(beta[3]), np.zeros(4), 1.0, 0)
    fitted = models.ResponseModel("label", ["a", "b", "c"], fixed, train, train, train)
    got = {r["feature"]: r["gradient"] for r in fitted.gradient().collect()}
    z = np.c_[x, np.ones(len(x))]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = z.T @ (weight * (1 / (1 + np.exp(-z @ beta)) - y)) + beta
    assert [got[n] for n in ("a", "b", "c", models.INTERCEPT)] == pytest.approx(want.tolist(), abs=1e-9)


def test_the_driver_hears_one_array_of_sums_from_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(64, 3))
    rows = [(float(i), [float(v) for v in x[i]]) for i in range(64)]
    df = spark.createDataFrame(rows, "one double, x array<double>").withColumn("features", array_to_vector("x"))
    written = blocks.sparse_blocks(df.repartition(8), "features", ("one",))
    heard, frames = [], type(df)
    collect = frames.collect

    def counted(self):
        rows = collect(self)
        heard.append(sum(len(r["sums"]) for r in rows))
        return rows

    monkeypatch.setattr(frames, "collect", counted)
    size = 150_001
    found = blocks.summed(written, lambda b: np.r_[b.n, b.dot_rows(b.given["one"], size - 1)], size)
    assert found[0] == 64 and found[1:4] == pytest.approx((x * np.arange(64)[:, None]).sum(axis=0).tolist())
    assert heard == [8 * size]
