"""Absorbed group effects against a regression on a column per level."""

import numpy as np
import pytest

from redressa.operators import absorption, models


def frame(spark, n=600):
    rng = np.random.default_rng(4)
    groups = [[rng.choice(list("abcdefgh")[:m]) if rng.random() > 0.03 else None for _ in range(n)] for m in (8, 5, 3)]
    effects = [{None: 0.4, **{x: rng.normal() * 2 for x in "abcdefgh"}} for _ in groups]
    of_level = sum(np.array([e[x] for x in g]) for e, g in zip(effects, groups, strict=True))
    t = of_level + rng.normal(size=n)
    y = 0.7 * t + 2 * of_level + rng.normal(size=n)
    rows = [(str(i), *(g[i] for g in groups), float(y[i]), float(t[i])) for i in range(n)]
    return groups, y, t, spark.createDataFrame(rows, "id string, g string, h string, k string, y double, t double")


def dummies(groups):
    columns = [np.array([x == level for x in g], dtype=float) for g in groups for level in sorted(set(g), key=str)]
    return np.column_stack(columns)


def test_residuals_equal_a_regression_on_levels(spark):
    groups, y, t, df = frame(spark)
    found = {r["id"]: (r["y"], r["t"]) for r in absorption.absorb(df, ("y", "t"), ("g", "h", "k"), tol=1e-10).collect()}
    x = dummies(groups)
    for place, values in enumerate((y, t)):
        want = values - x @ np.linalg.lstsq(x, values, rcond=None)[0]
        assert [found[str(i)][place] for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-8)


def test_slope_equals_the_regression_with_levels(spark):
    groups, y, t, df = frame(spark)
    left = absorption.absorb(df, ("y", "t"), ("g", "h", "k"), tol=1e-10)
    residuals = left.withColumnsRenamed({"y": "outcome_residual", "t": "treatment_residual"})
    slope = models.residual_slope(residuals).first()["slope"]
    x = np.column_stack([t, dummies(groups)])
    assert slope == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0][0], abs=1e-8)


def test_null_numbers_constant_columns_and_no_rows(spark):
    rows = [("a", 1.0, 5.0), ("a", 3.0, 5.0), (None, None, 5.0), (None, 8.0, 5.0), ("b", 2.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, y double, c double")
    got = sorted((r["g"], r["y"] is None, r["y"] or 0.0, r["c"]) for r in absorption.absorb(df, ("y", "c"), ("g",)).collect())
    assert got == [("Missing", False, 0.0, 0.0), ("Missing", True, 0.0, 0.0), ("a", False, -1.0, 0.0), ("a", False, 1.0, 0.0), ("b", False, 0.0, 0.0)]
    assert absorption.absorb(df.limit(0), ("y",), ("g",)).count() == 0
