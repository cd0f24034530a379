"""Language: held-out accuracy, spans of mixed text, and the exact recursion."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redressa.llm import language
from redressa.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_mixed_text_is_labelled_in_spans(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {k: docs.filter(f"lang = '{k}' AND n_chars > 1000").orderBy("doc_id").first().text[:700] for k in ("de", "fr")}
    name, share, spans = language.label_text(texts["de"] + "\n" + texts["fr"], model)
    assert [s[0] for s in spans][:1] == ["de"] and spans[-1][0] == "fr" and len(spans) <= 3
    assert 0.4 < share < 0.7 and name in ("de", "fr")


@pytest.mark.parametrize("seed", range(30))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    scores = (rng.normal(size=(7, 3)) * 3).astype(np.float32)

    def value(path):
        changes = sum(a != b for a, b in itertools.pairwise(path))
        return scores[np.arange(7), list(path)].sum() - 2.0 * changes

    best = max(value(p) for p in itertools.product(range(3), repeat=7))
    assert value(language.viterbi(scores, 2.0)) == pytest.approx(best, abs=1e-4)


def test_slices_do_not_change_the_labels(model, monkeypatch):
    rng = random.Random(0)
    text = " ".join(rng.choice(["the", "and", "über", "une", "que", "los"]) for _ in range(3000))
    whole = language.label_text(text, model)
    monkeypatch.setattr(language, "SLICE", 101)
    assert language.label_text(text, model) == whole
    assert list(language._label_many([text, "", text], model))[2] == whole


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 !!"), (None, "the and of"), (4, "the and of"), (4, "the and of"), (5, "Привет мир")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, score string")
    got = language.languages(docs, model).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1, 2, 3))
    assert by[4].lang_pred == by[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert language.languages(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the and", None)], "doc_id long, text string, lang string")
    empty = language.learn(docs)
    assert empty.languages == []
    assert language.languages(docs, empty).first().lang_pred == "und"


def test_scripts_narrow_the_candidates(spark):
    rows = [(0, "καλημέρα κόσμε " * 30, "el"), (2, "добрый день мир " * 30, "ru"), (3, "good day world " * 30, "en")]
    rows = [(d + 100 * k, t, g) for d, t, g in rows for k in range(9)]
    trained = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trained.languages == ["el", "en", "ru"]
    assert language.label_text("good мир добрый день добрый день добрый", trained)[0] == "ru"
    assert trained.writes.sum(axis=1)[language.SCRIPT_NAMES.index("greek")] == 1


def test_one_letter_words_and_texts_without_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["x y z", "b", "a b", "d e f g", "h", "i j"] * 4)]
    rows += [(100, "½½½½", None), (101, "ⅧⅧ 12", None), (102, "a " * 700_000, None), (103, "²³", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.languages(docs, language.learn(docs)).collect()}
    assert [got[i] for i in (0, 1, 2, 100, 101, 102, 103)] == ["en", "en", "en", "und", "und", "en", "und"]
