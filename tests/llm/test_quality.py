"""Quality rules against a plain reading, on whole small tables and odd rows."""

import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from redressa.llm import quality
from redressa.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, " \t\n ", "x"),
    (None, "a b c a b c", "y"),
    (4, "w", "y"),
    (4, "w", "y"),
    (5, "same line\nsame line\n\nsame line", "y"),
    (6, "a a a a a b #$ |", None),
    (7, "lots of words " * 3000, None),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1} if len(windows) < 5000 else set(windows[:3])
    covered = {i + k for i, x in enumerate(windows) if x in many for k in range(3)}
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text or ""),
        dup,
        len(covered),
    )


def bucket(*parts):
    value = 42
    for p in parts:
        value = xxhash.xxh64_intdigest(p.encode(), value)
    return (value - (1 << 64) if value >> 63 else value) % quality.BUCKETS


def grams(text):
    w = words(text)
    return [bucket(x) for x in w] + [bucket(*p) for p in zip(w, w[1:], strict=False)]


def test_measures_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    got = quality.score(docs, [0.0] * 10).collect()
    found = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == sorted(plain(t) for _, t, _ in ODD)
    assert all(r.score == 0.0 for r in got)


def test_scores_and_verdicts_of_a_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    every, trusted = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for r in rows:
        for g in grams(r.text):
            every[g] += 1
            trusted[g] += r.doc_id in good
    a, t = sum(every), sum(trusted)
    prior = quality.PRIOR_SHARE * t
    ratio = [
        math.log(((x + prior * y / a) / (t + prior)) / (y / a)) if y else 0.0
        for x, y in zip(trusted, every, strict=True)
    ]
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n, chars, symbols, dups, repeats = plain(r.text)
        mine, g = got[r.doc_id], grams(r.text)
        score = sum(ratio[x] for x in g) / max(len(g), 1)
        failed = n < 50 or 100 * repeats > 50 * n
        assert (mine.n_words, mine.word_chars, mine.n_symbols) == (n, chars, symbols)
        assert (mine.n_dup_lines, mine.n_repeat_words, mine.base_failed) == (dups, repeats, failed)
        assert mine.score == pytest.approx(score, abs=1e-5)
        assert mine.kept == (not failed and mine.score >= quality.THRESHOLD)


def test_keeps_columns_and_takes_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, 5), (None, text, 6), (2, "short", 7)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int")
    got = quality.keep_good(docs, labels, threshold=-1.0)
    assert got.columns == docs.columns
    assert sorted(r.kept for r in got.collect()) == [5, 6]
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 2
    assert docs.filter(F.lit(False)).transform(lambda d: quality.quality_rules(d, labels)).count() == 0


def test_no_python_in_the_plan(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality.quality_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_copies_of_the_table_change_no_verdict(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    copies = spark.range(12).withColumnRenamed("id", "copy")
    more_docs, more_labels = (
        t.crossJoin(F.broadcast(copies)).withColumn("doc_id", F.col("doc_id") * 12 + F.col("copy")) for t in (docs, labels)
    )
    alone = {r.doc_id: (r.kept, r.score) for r in quality.quality_rules(docs, labels).collect()}
    many = quality.quality_rules(more_docs, more_labels).collect()
    assert len(many) == 12 * len(alone)
    assert all(r.kept == alone[r.doc_id // 12][0] for r in many)
    assert all(r.score == pytest.approx(alone[r.doc_id // 12][1], abs=1e-5) for r in many)


def test_trusted_rows_are_bounded_and_cover_small_tables(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    assert quality.trusted_ids(labels, 3000).count() == 2500
    chosen = {r.doc_id for r in quality.trusted_ids(labels, 1000).collect()}
    assert 900 <= len(chosen) <= 1000 and all(i % 2 for i in chosen)
