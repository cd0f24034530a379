"""Nearest vectors against brute force over all rows."""

import math

import numpy as np
import pytest
from compare import TESTDATA
from pyspark.sql import functions as F

from redressa.llm import neighbours
from redressa.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, row string, bundle int, list int"


def is_query():
    return F.col("vec_id") % 100 == 0


def plain(ids, vectors, k=10):
    """(query, rank, id) and the exact distances."""
    x = np.array(vectors, dtype=np.float64)
    found, far = {}, {}
    for at in (i for i, v in enumerate(ids) if v % 100 == 0):
        distance = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        distance[at] = np.inf
        order = np.lexsort((ids, distance))[: min(k, len(ids) - 1)]
        found[ids[at]] = [(ids[o], distance[o]) for o in order]
        far[ids[at]] = {i: d for i, d in zip(ids, distance, strict=True)}
    return found, far


def answers(found):
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in by_query.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [r[1:] for r in rows] == sorted((r[1:] for r in rows), key=lambda r: (r[1], r[0]))
    return {q: [(v, s) for _, v, s in rows] for q, rows in by_query.items()}


def recall(got, want):
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in rows}) for q, rows in want.items())
    return hits / sum(len(rows) for rows in want.values())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    got = answers(QUERIES["op13_nearest_vectors"](spark, str(TESTDATA / sf)))
    rows = spark.read.parquet(str(TESTDATA / sf / "embeddings.parquet")).toPandas()
    want, far = plain(rows["vec_id"].tolist(), rows["embedding"].tolist())
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    assert all(math.isclose(far[q][v], s, rel_tol=1e-12) for q, found in got.items() for v, s in found)


def test_small_bundles_hot_copies_and_ties(spark, monkeypatch):
    """Lists of copies longer than a bundle, bundles with more queries than one load, and clusters."""
    for name, value in (("LIST", 16), ("PART", 40), ("QUERIES", 3), ("ROWS", 32)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 4
    vectors = [centres[i % 20] + rng.normal(size=8) * 0.3 for i in range(900)] + [centres[3]] * 500
    vectors = np.array(vectors, dtype=np.float32)
    ids = rng.permutation(len(vectors)).tolist()
    docs = spark.createDataFrame(
        [(i, v.tolist(), "x", 1, 2) for i, v in zip(ids, vectors, strict=True)], SCHEMA
    )
    got, (want, _) = answers(neighbours.nearest(docs, is_query())), plain(ids, vectors)
    assert recall(got, want) >= 0.95
    copies = set(ids[900:])
    for query in copies & want.keys():  # all ties: the smallest ids, found exactly
        assert [v for v, _ in got[query]] == [v for v, _ in want[query]]
        assert all(s == 0 for _, s in got[query])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 2.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]),
        (500, [inf, 1.0]), (600, [None, 1.0]), (700, []), (800, [1.0]), (None, [3.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
    ]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    found = neighbours.nearest(docs, is_query()).collect()
    of_zero = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 0)
    assert [(v, s) for _, v, s in of_zero] == [(7, 0.0), (7, 0.0), (100, 0.0), (None, 2.0), (100, math.sqrt(5))]
    assert sum(r.query_id == 100 for r in found) == 10 and {r.query_id for r in found} == {0, 100}
    assert neighbours.nearest(docs.limit(0), is_query()).count() == 0
    assert neighbours.nearest(docs.filter("vec_id = 300"), is_query()).count() == 0
    assert neighbours.nearest(docs.filter("vec_id = 0"), is_query()).count() == 0
    assert neighbours.nearest(docs.filter("vec_id = 7"), is_query()).count() == 0


def test_doubles_and_whole_numbers(spark):
    rows = [(i, [i * 1000003, 1]) for i in range(0, 300, 50)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    got, (want, _) = answers(neighbours.nearest(docs, is_query(), k=2)), plain(*zip(*rows, strict=True), k=2)
    assert got == want


def test_lists_are_balanced_and_boundaries_repeat():
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(size=(3000, 6)) * 0.2, rng.normal(size=(1000, 6)) * 3])
    index = neighbours.linked(neighbours.balanced_centroids(points, 40))
    rows, lists = neighbours.closures(index, points)
    sizes = np.bincount(lists, minlength=len(index.centroids))
    assert 30 <= len(sizes) <= 120 and sizes.max() <= 8 * len(points) / len(sizes)
    times = np.bincount(rows)
    assert times.min() == 1 and 1 < times.max() <= neighbours.COPIES


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(6)
    centroids, points = rng.normal(size=(600, 16)), rng.normal(size=(200, 16))
    found = neighbours.reach(neighbours.linked(centroids), points, 1.0, 32)
    exact = np.sqrt(((points[:, None] - centroids) ** 2).sum(axis=2))
    assert np.allclose(found[np.isfinite(found)], exact[np.isfinite(found)])
    assert np.isinf(found).any()
    hits = [len(set(f.argsort()[:8]) & set(e.argsort()[:8])) for f, e in zip(found, exact, strict=True)]
    assert np.mean(hits) >= 7.5
