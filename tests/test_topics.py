"""Terms, vocabularies, TF-IDF and the factorization, against dense numpy."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redressa.operators import topics, vectors
from redressa.session import materialize

TEXTS = [
    "Bank charged late payment fee on the card payment",
    "Late payment fee again, bank refused refund of fee",
    "Identity theft on my report, remove the fraud items",
    "Report shows identity theft; remove fraud from report",
    "",
    None,
    "Bank card fee fee fee",
]


@pytest.fixture(scope="module")
def words(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)]
    df = spark.createDataFrame(rows, "id int, consumer_narrative string")
    return materialize(vectors.narrative_words(df).select("id", "kept_words"), "test-words")


def python_terms(words):
    stops = set(vectors.default_stop_words())
    out = []
    for t in TEXTS * 4:
        kept = [w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
        kept = [w for w in kept if len(w) >= 3 and w not in stops]
        out.append(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])
    return out


def test_pairs_are_made_after_stop_words(words):
    got = [r["terms"] for r in vectors.with_terms(words).orderBy("id").collect()]
    assert got == python_terms(words)


def dense(words, min_df=5, max_df=0.9):
    docs = python_terms(words)
    n = len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    vocab = sorted(t for t, c in df.items() if min_df <= c <= max_df * n)
    x = np.zeros((n, len(vocab)))
    for i, d in enumerate(docs):
        for j, t in enumerate(vocab):
            x[i, j] = d.count(t) * (math.log((1 + n) / (1 + df[t])) + 1)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return vocab, np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def test_tfidf_equals_the_formula(words):
    vocab, x = dense(words)
    terms = vectors.with_terms(words)
    fitted = vectors.Vocabulary.of(vectors.fit_vocabulary(terms))
    assert fitted.terms == vocab
    weights = vectors.long_weights(vectors.with_tfidf(terms, fitted), "id", "tfidf", fitted)
    got = np.zeros_like(x)
    for r in weights.collect():
        got[r["id"], vocab.index(r["term"])] = r["weight"]
    assert got == pytest.approx(x, abs=1e-12)


def test_vocabulary_size_and_ties(words):
    fitted = vectors.fit_vocabulary(vectors.with_terms(words), size=3)
    counts = vectors.term_counts(vectors.with_terms(words)).collect()
    ranked = sorted(((-r["cf"], r["term"]) for r in counts if 5 <= r["df"] <= 0.9 * 28))[:3]
    assert [r["term"] for r in fitted.orderBy("term_id").collect()] == sorted(t for _, t in ranked)


def test_no_vocabulary_is_an_error(words):
    with pytest.raises(ValueError, match="document-frequency"):
        vectors.Vocabulary.of(vectors.fit_vocabulary(vectors.with_terms(words), min_df=1000))


def dense_loss(x, h):
    """Best loss for fixed h by projected gradient, run long."""
    gram, cross = h @ h.T, x @ h.T
    w = np.maximum(cross, 0)
    step = 1.0 / np.linalg.eigvalsh(gram).max()
    for _ in range(5000):
        w = np.maximum(w - step * (w @ gram - cross), 0)
    return ((x - w @ h) ** 2).sum(), w


@pytest.mark.parametrize("init", ["svd", "random"])
def test_factorization(words, init):
    _, x = dense(words)
    sparse, model = topics.fit_topics(words, "id", k=3, init=init, tol=1e-6)
    assert (model.h >= 0).all() and model.h.shape == (3, x.shape[1])
    assert all(a >= b - 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    loss, w = dense_loss(x, model.h)
    assert model.losses[-1] == pytest.approx(loss, rel=1e-3, abs=1e-3)
    best = (np.linalg.svd(x, compute_uv=False)[3:] ** 2).sum()
    assert best - 1e-9 <= model.losses[-1] < (x**2).sum()
    got = np.zeros((len(x), 3))
    for r in model.weights(sparse, "id").collect():
        got[r["id"]] = r["weights"]
    assert got == pytest.approx(w, abs=1e-3)


def test_keywords_and_dominant_topic(words, spark):
    sparse, model = topics.fit_topics(words, "id", k=2)
    rows = model.keywords(words, top=4).orderBy("topic").collect()
    terms = model.vocabulary.terms
    for r in rows:
        h = model.h[r["topic"]]
        order = sorted(range(len(terms)), key=lambda j: (-h[j], terms[j]))[:4]
        assert r["keywords"].split(", ") == [terms[j] for j in order]
        assert r["top_weight"] == pytest.approx(h.max())
    weights = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.7]), (3, [0.4, 0.4])], "id int, weights array<double>")
    got = {r["id"]: (r["dominant_topic"], r["dominant_topic_weight"]) for r in topics.dominant_topic(weights).collect()}
    assert got == {1: (0, 0.0), 2: (1, 0.7), 3: (0, 0.4)}
    found = topics.dominant_topic(model.weights(sparse, "id"))
    by_id = {r["id"]: r["dominant_topic"] for r in found.collect()}
    assert by_id[0] == by_id[1] != by_id[2] == by_id[3]


def test_topic_count():
    assert (topics.topic_count(1999), topics.topic_count(2000)) == (5, 8)


def test_long_document_is_whole(spark):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20000))
    df = spark.createDataFrame([(1, text)], "id int, consumer_narrative string")
    terms = vectors.with_terms(vectors.narrative_words(df))
    assert terms.select(F.size("terms")).first()[0] == 20000 + 19999
    assert vectors.term_counts(terms).agg(F.sum("cf")).first()[0] == 39999


def test_products_unfold_few_rows_at_once(monkeypatch):
    monkeypatch.setattr(topics, "SLICE", 4)
    rng = np.random.default_rng(2)
    x = (rng.random((10, 6)) < 0.4) * rng.random((10, 6))
    x[3] = 0
    indices = pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32()))
    values = pa.array([r[r != 0].tolist() for r in x], pa.list_(pa.float64()))
    parts = list(topics._slices(indices, values))
    assert [b.n for b in parts] == [4, 4, 2]
    dense, left = rng.random((6, 3)), rng.random((10, 3))
    assert np.allclose(np.vstack([b.times(dense) for b in parts]), x @ dense)
    at = [0, 4, 8, 10]
    turned = sum(b.transposed_times(left[i:j], 6) for b, i, j in zip(parts, at, at[1:], strict=False))
    assert np.allclose(turned, x.T @ left)


def test_term_uses_are_emitted_without_a_lambda(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "terms array<string>")
    counts = vectors.term_counts(df)
    assert {tuple(r) for r in counts.collect()} == {("a", 3, 2), ("b", 1, 1)}
    assert "lambda" not in counts._jdf.queryExecution().executedPlan().toString()


def test_numbered_pairs_give_the_same_vocabulary_and_uses(spark):
    rng = np.random.default_rng(3)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    rows = [
        (f"s{i % 3}" if i % 7 else None, rng.choice(words, size=int(rng.integers(0, 30)), p=share / share.sum()).tolist())
        for i in range(200)
    ]
    rows += [("s0", None), ("few", ["once", "twice", "twice"])]
    df = spark.createDataFrame(rows, "source string, kept_words array<string>")
    terms = vectors.with_terms(df)
    for options in ({"size": 20}, {"size": 5000}, {"size": 35, "min_df": 20, "max_df": 0.5}, {"size": 20, "min_df": 1, "max_df": 1.0}):
        plain = vectors.fit_vocabulary(terms, **options).collect()
        found = vectors.fit_vocabulary(terms, **options, words="kept_words").collect()
        assert sorted(plain) == sorted(found) and any(" " in r["term"] for r in found)
        counted = vectors._leading_counts(df, "kept_words", options.get("min_df", 5), options.get("max_df", 0.9), options["size"])
        assert counted.count() < vectors.term_counts(terms).count()
    uses = terms.select("source", F.explode("terms").alias("term")).groupBy("source", "term")
    uses = uses.agg(F.count(F.lit(1)).alias("weight"))
    leading = vectors.leading_uses(df, "source", "kept_words", 5)
    assert leading.count() < uses.count()
    lists = [sorted(topics.keyword_lists(u, "source", 5).collect(), key=str) for u in (uses, leading)]
    assert lists[0] == lists[1] and len(lists[0]) == 5


def test_too_many_words_are_counted_without_numbers(spark, monkeypatch):
    df = spark.createDataFrame([("a", ["one", "two", "one", "two"])] * 6, "source string, kept_words array<string>")
    monkeypatch.setattr(vectors, "NUMBERED", 1)
    terms = vectors.with_terms(df)
    plain = vectors.fit_vocabulary(terms, max_df=1.0).collect()
    assert sorted(plain) == sorted(vectors.fit_vocabulary(terms, max_df=1.0, words="kept_words").collect())
    assert {r["term"]: r["weight"] for r in vectors.leading_uses(df, "source", "kept_words", 3).collect()}["one two"] == 12


def test_vectors_of_words_equal_those_of_their_terms(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELLS", 20)
    lists = [["late", "fee", "late", "fee"], [], ["x"], ["fee"], ["a b", "c"], ["a", "b c"], ["late", "", "fee"], ["fee", "late", "x"] * 30]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, words array<string>").coalesce(1)
    vocabulary = vectors.Vocabulary(["a", "a b c", "fee", "fee late", "late", "late fee", "late "], [1.1, 1.2, 1.3, 1.7, 1.9, 2.3, 0.7])
    given = vectors.with_tfidf(vectors.with_terms(df, "words"), vocabulary).sort("id").collect()
    found = vectors.with_tfidf(df, vocabulary, words="words").sort("id").collect()
    assert [r.tfidf for r in found] == [r.tfidf for r in given]
    assert all(type(a.tfidf) is type(b.tfidf) for a, b in zip(found, given, strict=True))
    nothing = spark.createDataFrame([(1, None)], "id int, words array<string>")
    assert vectors.with_tfidf(nothing, vocabulary, words="words").first().tfidf.numNonzeros() == 0
