"""Field parsing, classing and cleaning on hand-written rows."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from redressa.functions import fields
from redressa.operators import cleaning

# Published counts of raw product names and of product groups.
PRODUCTS = {
    "Credit reporting, credit repair services, or other personal consumer reports": 18866,
    "Debt collection": 5115,
    "Credit card or prepaid card": 2291,
    "Checking or savings account": 1858,
    "Student loan": 799,
    "Credit reporting or other personal consumer reports": 680,
    "Vehicle loan or lease": 515,
    "Credit card": 76,
    "Mortgage": 38,
    "Money transfer, virtual currency, or money service": 11,
    "Payday loan, title loan, or personal loan": 7,
    "Payday loan, title loan, personal loan, or advance loan": 2,
    "Debt or credit management": 1,
    "Prepaid card": 1,
    "Credit reporting": 1,
    "Consumer Loan": 1,
    "Money transfers": 1,
}
GROUPS = {
    "Credit reporting": 19547,
    "Debt collection": 5115,
    "Credit card/prepaid": 2368,
    "Bank account": 1858,
    "Student loan": 799,
    "Vehicle loan/lease": 515,
    "Mortgage": 38,
    "Money transfer": 12,
    "Consumer loan": 10,
    "Other": 1,
}


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_product_groups_of_the_published_counts(spark):
    df = spark.createDataFrame(list(PRODUCTS.items()), "product string, n long")
    got = df.groupBy(fields.product_group(F.col("product")).alias("g")).agg(F.sum("n").alias("n"))
    assert {r["g"]: r["n"] for r in got.collect()} == GROUPS


def test_product_rules(spark):
    rows = ["Vehicle loan or lease", "release", "Credit card debt collection", None, "x"]
    assert values(spark, fields.product_group, rows) == [
        "Vehicle loan/lease",
        "Vehicle loan/lease",
        "Credit card/prepaid",
        "Other",
        "Other",
    ]


def test_response_classes(spark):
    rows = [
        "Closed with monetary relief",
        "Closed with non-monetary relief",
        "Closed without relief",
        "In progress",
        None,
        "  CLOSED WITH EXPLANATION ",
    ]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    classes = fields.response_classes(F.col("v"))
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in classes.items()]).collect()]
    assert got == [
        ("monetary_relief", 1, 0, 1, 0, 1),
        ("non_monetary_relief", 0, 1, 1, 0, 1),
        ("other", 0, 0, 0, 0, 1),
        ("other", 0, 0, 0, 0, 0),
        ("other", 0, 0, 0, 0, 0),
        ("explanation", 0, 0, 0, 1, 1),
    ]


def test_yes_no(spark):
    rows = [" Yes ", "Y", "TRUE", "1", "no", "N\t", "false", "0", "maybe", "", None]
    assert values(spark, fields.parse_yes_no, rows) == [1.0] * 4 + [0.0] * 4 + [None] * 3


def test_dates(spark):
    rows = [
        "2022-11-30",
        "11/30/2022",
        "1/2/2022",
        "2022-11-30 12:30:00",
        "2022-11-30T12:30:00+02:00",
        "2022-11-30T12:30:00.250Z",
        "November 3, 2022",
        "20221130",
        "2022/11/30",
        "11-30-2022",
        "30 Nov 2022",
        "11/30/22",
        "11/30/2022 12:30",
        "11/30/2022 1:05:09 PM",
        "2022-11-30T12:30Z",
        "2022-11-30 12:30:00-05:00",
        "bad",
        "2022-13-01",
        None,
    ]
    d = dt.datetime
    assert values(spark, lambda c: fields.parse_date(c).cast("string"), rows) == [
        str(v) if v else None
        for v in [
            d(2022, 11, 30),
            d(2022, 11, 30),
            d(2022, 1, 2),
            d(2022, 11, 30, 12, 30),
            d(2022, 11, 30, 10, 30),
            "2022-11-30 12:30:00.25",
            d(2022, 11, 3),
            d(2022, 11, 30),
            d(2022, 11, 30),
            d(2022, 11, 30),
            d(2022, 11, 30),
            d(2022, 11, 30),
            d(2022, 11, 30, 12, 30),
            d(2022, 11, 30, 13, 5, 9),
            d(2022, 11, 30, 12, 30),
            d(2022, 11, 30, 17, 30),
            None,
            None,
            None,
        ]
    ]


def test_na_tokens(spark):
    assert values(spark, fields.null_if_na, ["N/A", "None", "", "none", "N/A ", None]) == [
        None,
        None,
        None,
        "none",
        "N/A ",
        None,
    ]


def test_header_names():
    assert cleaning.header_name(" Timely response? ") == "timely_response"
    assert cleaning.header_name("Company response -- to consumer") == "company_response_to_consumer"
    assert cleaning.header_name("__ZIP  code") == "zip_code"


def test_standardize_takes_the_first_alias_and_the_left_duplicate(spark):
    df = spark.createDataFrame(
        [("a", None, "right", "n2", None), (None, "left", "right", "n2", "n1")],
        "`State` string, ` state` string, `STATE?` string, consumer_narrative string,"
        " `Consumer complaint narrative` string",
    )
    got = cleaning.standardize(df).select("state", "consumer_narrative", "company").collect()
    assert [tuple(r) for r in got] == [("a", "n2", None), ("left", "n1", None)]


def raw_rows(spark, rows):
    names = "complaint_id, ingest_seq, date_received, date_sent_to_company, company_response, text"
    df = spark.createDataFrame(
        rows,
        "complaint_id string, ingest_seq long, date_received string, date_sent string,"
        " company_response string, text string",
    )
    assert len(df.columns) == len(names.split(", "))
    out = cleaning.standardize(
        df.withColumnsRenamed({"date_sent": "date_sent_to_company", "text": "consumer_narrative"}),
        keep=("ingest_seq",),
    )
    return out


def test_clean_complaints(spark):
    raw = raw_rows(
        spark,
        [
            ("1", 5, "2022-11-30 00:00:00", "2022-11-29 23:00:00", "Closed", "late copy"),
            ("1", 1, "2022-11-29", "2022-12-01 12:00:00", "Closed with monetary relief", "first"),
            (None, 2, "bad", None, "Closed", "x"),
            (None, 3, "2022-11-30", None, "Closed", "y"),
            ("2", 4, "2022-11-30 00:00:00", "2022-11-29 23:00:00", None, " "),
        ],
    )
    out = cleaning.clean_complaints(raw)
    assert len(out.columns) == 53
    rows = {r["complaint_id"]: r for r in out.collect()}
    assert set(rows) == {"1", "2", None}
    first = rows["1"]
    assert first["consumer_narrative"] == "first" and first["any_relief"] == 1
    assert (first["days_to_company"], first["post_cutoff"]) == (2, 0)
    assert (first["complaint_year"], first["complaint_month"]) == (2022, "2022-11")
    assert first["complaint_quarter"] == "2022Q4"
    assert rows["2"]["days_to_company"] == -1 and rows["2"]["post_cutoff"] == 1
    assert rows["2"]["has_narrative"] == 0 and rows["2"]["n_sentences"] == 1
    assert rows[None]["consumer_narrative"] == "x" and rows[None]["post_cutoff"] == 0
    assert [r["complaint_id"] for r in cleaning.modeling_rows(out).collect()] == ["1"]
    notes = {r["variable"]: r["rows_with_value"] for r in cleaning.feature_dictionary(out).collect()}
    assert len(notes) == 14 and notes["post_cutoff"] == 3 and notes["timely_binary"] == 0


def test_empty_input(spark):
    out = cleaning.clean_complaints(raw_rows(spark, []))
    assert out.count() == 0


def test_dates_equal_pandas(spark):
    rows = [
        " 2022-11-30 ",
        "Nov. 30, 2022",
        "2022-11-30 10:00:00 AM",
        "30-Nov-2022",
        "2022-1-5",
        "Wed, 30 Nov 2022",
        "2022-11",
        "2022-11-30 10:00:00.1234567",
        "2022-11-30T10:00:00+0000",
        "2022-11-30 12:00:00 AM",
        "November 30 2022 5:06 pm",
        "1/2/68",
        "1/2/76",
        "30/11/2022",
        "13/13/2022",
        "Foo 3, 2022",
        "2022-02-30",
        "9 pm",
    ]
    got = values(spark, lambda c: F.unix_micros(fields.parse_date(c)), rows)
    want = pd.to_datetime(pd.Series(rows), format="mixed", errors="coerce", utc=True)
    readable = rows[:14]
    assert got[: len(readable)] == [t.value // 1000 for t in want[: len(readable)]]
    assert got[len(readable) :] == [None] * (len(rows) - len(readable))
