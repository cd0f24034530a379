"""Profile tables on small frames."""

import pytest

from redressa.operators import profile


def test_constant_and_missing_values_in_correlations(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, 0), (2.0, 5.0, 1), (None, 5.0, 1), (4.0, 5.0, 1)],
        "x double, constant double, any_relief int",
    )
    got = {r["feature"]: r["correlation"] for r in profile.correlate_with(df, ["x", "constant"]).collect()}
    assert got["constant"] is None
    assert got["x"] == pytest.approx(0.7559289460184544)  # over the three full pairs


def test_null_groups_are_dropped_but_missing_is_counted(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "g string, any_relief int")
    rates = profile.group_rates(df, "g", {"rate": "any_relief"}).collect()
    assert [tuple(r) for r in rates] == [("a", 2, 0.5)]
    shares = {r["g"]: (r["n"], r["share"]) for r in profile.value_share(df, "g").collect()}
    assert shares == {"a": (2, pytest.approx(2 / 3)), "Missing": (1, pytest.approx(1 / 3))}


def test_share_is_of_all_rows_also_below_the_top(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbc"], "g string")
    got = [tuple(r) for r in profile.value_share(df, "g", top=2).collect()]
    assert got == [("a", 3, 0.5), ("b", 2, pytest.approx(1 / 3))]


def test_long_form_equals_single_tables(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "y")], "g string, h string")
    long = profile.value_shares(df, ["g", "h"], top=2).orderBy("variable", "rank").collect()
    for column in ("g", "h"):
        single = [tuple(r) for r in profile.value_share(df, column, top=2).collect()]
        assert [(r["value"], r["n"], r["share"]) for r in long if r["variable"] == column] == single


def test_small_groups_and_top(spark):
    df = spark.createDataFrame([(c, 1) for c in "aaabbc"], "g string, any_relief int")
    got = profile.group_rates(df, "g", {"rate": "any_relief"}, min_n=2, top=1).collect()
    assert [tuple(r) for r in got] == [("a", 3, 1.0)]


def test_profile_of_no_rows(spark):
    names = ["date_received", *profile.PERIOD_MEASURES, "post_cutoff", "product", "issue", "company", "state"]
    kinds = {"date_received": "timestamp", "product": "string", "issue": "string"}
    kinds |= {"company": "string", "state": "string"}
    schema = ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names)
    row = profile.dataset_profile(spark.createDataFrame([], schema)).first()
    assert row["rows"] == 0 and row["any_relief_rate"] is None and row["unique_states"] == 0
