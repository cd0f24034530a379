"""Readers and writers, round trip."""

import json

import pytest
from pyspark.sql import functions as F

from redressa.operators import cleaning
from redressa.sources import readers, writers

HEADER = "Complaint ID,Consumer complaint narrative,State,Timely response?\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_keeps_quotes_commas_and_lines(spark, tmp_path):
    body = '1,"He said ""no"", then\nleft, twice",N/A,Yes\n2,None,FL,\n'
    df = readers.read_csv(spark, write(tmp_path / "a.csv", HEADER + body))
    got = cleaning.standardize(df).select("complaint_id", "consumer_narrative", "state")
    assert [tuple(r) for r in got.orderBy("complaint_id").collect()] == [
        ("1", 'He said "no", then\nleft, twice', None),
        ("2", None, "FL"),
    ]


ROWS = [
    ("1", 'say ""yes"", then\nline two\n\nline four', "FL"),
    ("2", "plain", ""),
    ("3", "\n" * 40 + "after many, breaks", "CA"),
    ("4", '""', "NY"),
    ("5", "é" * 300 + "\r\nwindows", "TX"),
]


@pytest.mark.parametrize("block", [16, 50, 333, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_of_a_file_give_the_rows_of_the_whole_file(spark, tmp_path, block, end):
    """Blocks that begin and end anywhere: in quotes, between doubled quotes, and inside characters."""
    lines = ["id,text,state"] + [f'{i},"{t}",{s}' for i, t, s in ROWS * 6] + ["", "9,last,WA"]
    path = write(tmp_path / "a.csv", end.join(lines))
    set_to = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        found = readers.read_csv(spark, path, whole_bytes=0).collect()
        whole = readers.read_csv(spark, path, whole_bytes=1 << 30).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", set_to)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    if block < 1000:
        assert len({r["ingest_seq"]["block"] for r in found}) > 5
    rows = [r[:3] for r in sorted(found, key=lambda r: r["ingest_seq"][2:])]
    assert rows == [(i, t.replace('""', '"'), s or None) for i, t, s in ROWS * 6] + [("9", "last", "WA")]
    if end == "\n":  # in files with \r\n, Spark's own scan makes a line feed of each such break in a text
        assert rows == [r[:3] for r in sorted(whole, key=lambda r: r["ingest_seq"][2:])]


def test_irregular_quotes_are_read_file_by_file(spark, tmp_path):
    for name, text in (("a", '1,5" pipe of x,FL\n2,b,CA\n'), ("b", '3,"x\ny",FL\n')):
        write(tmp_path / f"{name}.csv", "id,text,state\n" + text)
    found = readers.read_csv(spark, str(tmp_path), whole_bytes=0)
    assert sorted(r[:3] for r in found.collect()) == [("1", '5" pipe of x', "FL"), ("2", "b", "CA"), ("3", "x\ny", "FL")]


def test_ingest_order_follows_the_sources(spark, tmp_path):
    a = write(tmp_path / "a.csv", HEADER + "1,first,FL,Yes\n2,x,FL,Yes\n")
    b = write(tmp_path / "b.csv", HEADER + "1,second,CA,Yes\n")
    frames = [
        cleaning.standardize(readers.read_csv(spark, path, i), keep=("ingest_seq",))
        for i, path in enumerate([a, b])
    ]
    union = cleaning.union_sources([("b", frames[1]), ("a", frames[0])])
    kept = cleaning.first_per_key(union, "complaint_id").orderBy("complaint_id").collect()
    assert [(r["consumer_narrative"], r["raw_source"]) for r in kept] == [("first", "a"), ("x", "a")]


def test_union_fills_missing_columns_and_keeps_copies(spark):
    a = spark.createDataFrame([("1", "x")], "id string, only_a string")
    b = spark.createDataFrame([("1", "y"), ("1", "y")], "id string, only_b string")
    union = cleaning.union_sources([("a", a), ("b", b)])
    assert union.count() == 3
    assert union.filter("only_a is null").count() == 2
    manifest = {r["raw_source"]: r["rows"] for r in cleaning.source_manifest(union).collect()}
    assert manifest == {"a": 1, "b": 2, "all sources": 3}


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError, match="unsupported format"):
        readers.read_table(spark, "x", "xlsx")


def test_hits_envelopes(spark, tmp_path):
    nested = {"hits": {"hits": [{"_source": {"complaint_id": "1", "n": 5}}, {"complaint_id": "2"}, 7]}}
    flat = {"hits": [{"_source": {"complaint_id": "3"}}, "text", {"complaint_id": "4"}]}
    other = {"hits": 3, "took": 1}
    for i, payload in enumerate([nested, flat, other, {}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(payload, indent=1))
    got = readers.read_hits(spark, str(tmp_path), ["complaint_id", "n"]).collect()
    assert sorted((r["complaint_id"], r["n"]) for r in got) == [
        ("1", "5"),
        ("2", None),
        ("3", None),
        ("4", None),
    ]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_tables_are_overwritten(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 'a "b", c')], "id int, s string")
    writers.write_table(df.withColumn("id", F.lit(2)), path, fmt)
    writers.write_table(df, path, fmt)
    reader = spark.read.schema(df.schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    assert [tuple(r) for r in reader.format(fmt).load(path).collect()] == [(1, 'a "b", c')]


def test_copies_are_reused_unless_forced(spark, tmp_path):
    path = str(tmp_path / "copy")
    one, two = (spark.range(n).toDF("id") for n in (1, 2))
    assert writers.write_once(one, path).count() == 1
    assert writers.write_once(two, path).count() == 1
    assert writers.write_once(two, path, force=True).count() == 2


def test_records(spark, tmp_path):
    path = str(tmp_path / "record.json")
    writers.write_record(spark, {"a": 1, "b": None}, path)
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    assert json.loads(text) == {"a": 1, "b": None}


def test_csv_files_with_other_headers_are_united_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", "Complaint ID,State,Product\n1,FL,Loan\n")
    write(tmp_path / "b.csv", "State,Complaint ID,Issue,Product\nNY,2,Fees,\n")
    write(tmp_path / "empty.csv", "")
    df = cleaning.standardize(readers.read_csv(spark, str(tmp_path)))
    got = df.select("complaint_id", "state", "product", "issue").orderBy("complaint_id").collect()
    assert [tuple(r) for r in got] == [("1", "FL", "Loan", None), ("2", "NY", None, "Fees")]


def test_an_unfinished_copy_is_written_anew(spark, tmp_path):
    df, path = spark.range(9).toDF("id"), str(tmp_path / "copy")
    df.filter("id < 2").write.parquet(path)
    assert writers.write_once(df, path).count() == 2
    (tmp_path / "copy" / "_SUCCESS").unlink()
    assert writers.write_once(df, path).count() == 9
    assert writers.write_once(df.limit(1), path).count() == 9
    assert writers.write_once(df.limit(1), path, force=True).count() == 1


def test_na_texts_are_null_in_any_source(spark):
    df = spark.createDataFrame([("1", "None", "N/A")], "complaint_id string, state string, product string")
    assert cleaning.standardize(df).select("state", "product").first() == (None, None)
