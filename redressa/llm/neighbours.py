"""Nearest vectors by balanced posting lists.

The index is a set of centroids, each with the list of the vectors near it. Centroids come from balanced k-means: a sample is split
again and again, branches that draw more than their share are made less attractive, and a branch with more than its part of
the sample is split further. So lists have about ``LIST`` vectors, and neighbours in the order of the tree are near
each other. A vector goes to its nearest centroid and, at a boundary, to others up to ``CLOSURE`` times as far, unless a centroid chosen
before is nearer to that one than the vector is (then both lists would be searched together anyway).

Centroids are searched in memory by a graph: each points to its nearest others, to its neighbours in the tree, and to two far ones;
a search starts at spread entries and follows the nearest open centroids, many vectors at a time. A query reads the lists whose
centroids are up to ``RATIO`` times as far as the nearest; at least ``LEAST`` lists, and enough of them to hold ``NEEDED`` times the wanted
number (else all). There is no cap: the ratio decides.

Only the centroids (at most about ``MAX_LISTS``), their graph and the list sizes are on the driver or sent to all tasks. Lists
are packed in tree order into bundles of about ``PART`` vectors; a longer list, such as that of a hot group of copies, is dealt into several bundles,
each of which its queries read. A query travels once to a bundle, with the numbers of its lists there, and a bundle
with more than ``QUERIES`` queries is repeated for parts of them, so every task has bounded tables on both sides. Of equal vectors in a bundle only the
first few can be in any answer, so copies do not multiply the work. Distances are sums of squared differences in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of another length than
the commonest (the shorter of equally common ones). A null id is no query and comes last among ties. Rows equal in id and vector are separate
rows: only the query's own row is left out of its answer. Fewer candidates than wanted are all returned. Extra columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.session import discard, materialize

K = 10
LIST = 512
MAX_LISTS = 8192
# The index is fitted on about this many vectors by smallest hash of their place, fewer if they are very long.
SAMPLE = 65_536
SAMPLE_VALUES = 1 << 24

CLOSURE = 1.1
COPIES = 8
RATIO = 1.2
LEAST = 8
NEEDED = 16
BEAM = 32

BRANCHES = 16
BALANCE = 0.1
NEAREST, FAR, ENTRIES, STEP = 12, 2, 16, 4
ROWS = 256
PART = 8192
QUERIES = 4096

# Workers need not have this package installed: its code travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Index:
    """Centroids in tree order, and the graph over them."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def _branches(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Branch of each point by balanced k-means."""
    centres = points[rng.choice(len(points), k, replace=False)]
    counts = np.full(k, len(points) / k)
    for _ in range(8):
        far = _squared(points, centres)
        cost = far + BALANCE * far.min(axis=1).mean() * counts * k / len(points)
        branch = cost.argmin(axis=1)
        counts = np.bincount(branch, minlength=k).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, branch, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return branch


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """About ``lists`` centroids in tree order; none stands for much more than its part of the points."""
    rng = np.random.default_rng(seed)
    most = 1.3 * len(points) / lists
    found, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        own = points[rows]
        parts = []
        if len(rows) > most and (own != own[0]).any():
            k = int(min(BRANCHES, max(2, round(len(rows) * lists / len(points))), len(rows)))
            branch = _branches(own, k, rng)
            parts = [rows[branch == b] for b in range(k) if (branch == b).any()]
        if len(parts) > 1:
            open_ += reversed(parts)
        else:
            found.append(own.mean(axis=0))
    _, once = np.unique(np.array(found), axis=0, return_index=True)
    return np.array(found)[np.sort(once)]


def linked(centroids: np.ndarray, seed: int = 11) -> Index:
    """The graph: nearest centroids, tree neighbours and far links of each."""
    n = len(centroids)
    near = min(NEAREST, n - 1)
    rows = [np.zeros((0, near), dtype=np.int64)]
    for at in range(0, n, 512):
        far = _squared(centroids[at : at + 512], centroids)
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        rows.append(np.argsort(far, axis=1, kind="stable")[:, :near])
    own = np.arange(n)[:, None]
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    links = np.hstack([np.vstack(rows), (own + 1) % n, (own - 1) % n, far])
    return Index(centroids, links, np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64)))


def reach(index: Index, points: np.ndarray, ratio: float, beam: int) -> np.ndarray:
    """Distances from ``points`` to the centroids that the graph search saw; infinite to others.

    A point's search goes on while there is an open centroid among its ``beam`` nearest ones or up to
    ``ratio`` times as far as its nearest.
    """
    n = len(index.centroids)
    far = np.full((len(points), n), np.inf)
    far[:, index.entries] = np.sqrt(_squared(points, index.centroids[index.entries]))
    closed = np.zeros(far.shape, dtype=bool)
    active = np.arange(len(points))
    beam = min(beam, n)
    while len(active):
        seen = far[active]
        bound = np.maximum(ratio * seen.min(axis=1), np.partition(seen, beam - 1, axis=1)[:, beam - 1])
        seen[closed[active] | (seen > bound[:, None])] = np.inf
        step = min(STEP, n)
        picks = np.argpartition(seen, step - 1, axis=1)[:, :step]
        real = np.isfinite(np.take_along_axis(seen, picks, axis=1))
        rows, nodes = active[np.nonzero(real)[0]], picks[real]
        active = active[real.any(axis=1)]
        closed[rows, nodes] = True
        rows, nodes = np.repeat(rows, index.links.shape[1]), index.links[nodes].ravel()
        new = np.isinf(far[rows, nodes])
        pairs = np.unique(rows[new] * n + nodes[new])
        rows, nodes = pairs // n, pairs % n
        far[rows, nodes] = np.sqrt(((points[rows] - index.centroids[nodes]) ** 2).sum(axis=1))
    return far


def closures(index: Index, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list that a point belongs to."""
    far = reach(index, points, 1.0, 2 * COPIES)
    width = min(2 * COPIES, far.shape[1])
    nodes = np.argsort(far, axis=1, kind="stable")[:, :width]
    far = np.take_along_axis(far, nodes, axis=1)
    there = index.centroids[nodes]
    size = (there * there).sum(axis=2)
    between = np.sqrt(np.maximum(size[:, :, None] + size[:, None, :] - 2 * there @ there.transpose(0, 2, 1), 0))
    kept = np.zeros(far.shape, dtype=bool)
    kept[:, 0] = True
    for at in range(1, width):
        nearer = (kept[:, :at] & (between[:, at, :at] < far[:, at, None])).any(axis=1)
        kept[:, at] = (far[:, at] <= CLOSURE * far[:, 0]) & ~nearer & (kept.sum(axis=1) < COPIES)
    rows, columns = np.nonzero(kept)
    return rows, nodes[rows, columns]


def probes(index: Index, points: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list that a query reads."""
    far = reach(index, points, RATIO, BEAM)
    nodes = np.argsort(far, axis=1, kind="stable")
    near = np.take_along_axis(far, nodes, axis=1)
    held = np.cumsum(sizes[nodes], axis=1)
    wanted = (near <= RATIO * near[:, :1]) | (np.arange(far.shape[1]) < LEAST) | (held - sizes[nodes] < NEEDED * k)
    # The graph may not have seen lists that are needed for their vectors; then all are read.
    short = np.where(wanted & np.isfinite(near), sizes[nodes], 0).sum(axis=1) < NEEDED * k
    wanted = (wanted & np.isfinite(near)) | short[:, None]
    rows, columns = np.nonzero(wanted)
    return rows, nodes[rows, columns]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in chunks]
    return np.concatenate(parts).astype(np.float64) if parts else np.empty((0, dim))


def usable(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``id``, ``v`` and ``row`` of the rows that take part, and the length of their vectors (0 if there are none)."""
    kind = df.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if kind == "float" else F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).alias("id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.filter(F.exists("v", lambda x: x != 0) & ~bad), "vectors")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    found = common.select("dim").collect()
    dim = found[0][0] if found else 0
    ours = materialize(rows.filter(F.size("v") == dim), "usable")
    discard(rows)
    return ours, dim


def fit(rows: DataFrame, lists: int, dim: int, n: int) -> Index:
    """Centroids and graph from a bounded sample, made in one task."""
    part = min(1.0, min(SAMPLE, SAMPLE_VALUES // dim) / n)
    sample = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 24)) < int(part * (1 << 24) + 1)).select("v")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = [_matrix(batch.column(0), dim) for batch in batches]
        if points:
            centroids = balanced_centroids(np.concatenate(points), lists)
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(centroids)), "centroid": list(centroids)})

    found = sample.coalesce(1).mapInArrow(build, "at long, centroid array<double>").orderBy("at").toArrow()
    return linked(_matrix(found["centroid"], dim))


def postings(rows: DataFrame, index: Index, dim: int) -> DataFrame:
    """``list``, ``row``, ``id``, ``v``: a row for each list that a vector belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owners, lists = closures(index, _matrix(part.column("v"), dim))
                part = part.take(pa.array(owners))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *part.columns], ["list", *part.schema.names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return materialize(rows.mapInArrow(run, f"list int, {fields}"), "postings")


def bundles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bundle of each list, and over how many bundles it is dealt."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    bundle, room = 0, PART
    for at, size in enumerate(sizes):
        if size > room and room < PART:
            bundle, room = bundle + 1, PART
        first[at] = bundle
        if size > PART:
            parts[at] = -(-size // PART)
            bundle, room = bundle + parts[at], PART
        else:
            room -= size
    return first, parts


def _queries(rows: DataFrame, index: Index, sizes: np.ndarray, dim: int, k: int) -> DataFrame:
    """``bundle``, ``row``, ``id``, ``v`` and the ``lists`` to read there, for each query and bundle."""
    first, parts = bundles(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owners, lists = probes(index, _matrix(part.column("v"), dim), sizes, k)
                times = parts[lists]
                owners, lists = np.repeat(owners, times), np.repeat(lists, times)
                bundle = first[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((lists, bundle, owners))
                owners, lists, bundle = owners[order], lists[order], bundle[order]
                starts = np.flatnonzero(np.r_[True, (owners[1:] != owners[:-1]) | (bundle[1:] != bundle[:-1])])
                taken = part.take(pa.array(owners[starts]))
                held = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(lists)], pa.int32()), pa.array(lists, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bundle[starts], pa.int64()), *taken.columns, held],
                    ["bundle", *taken.schema.names, "lists"],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return materialize(rows.mapInArrow(run, f"bundle long, {fields}, lists array<int>"), "queries")


def _few_of_equal(points: np.ndarray, lists: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that have ``k`` equal vectors of lower place in their list."""
    whole = np.ascontiguousarray(np.hstack([lists[:, None].astype(np.float64), points]))
    _, same = np.unique(whole.view(f"V{whole.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.lexsort((place, same))
    group = same[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    number = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[number < k])


def scan(vectors: pa.Table, queries: pa.Table, dim: int, k: int) -> pa.Table:
    """The ``k`` nearest of one bundle's vectors to each query, in the lists it reads."""
    points, asked = _matrix(vectors["v"], dim), _matrix(queries["v"], dim)
    lists, rows = vectors["list"].to_numpy(), vectors["row"].to_numpy()
    place = np.empty(len(points), dtype=np.int64)
    place[pc.sort_indices(vectors, [("id", "ascending"), ("row", "ascending")]).to_numpy()] = np.arange(len(points))
    kept = _few_of_equal(points, lists, place, k + 1)
    held = queries["lists"].combine_chunks()
    reader, read = pc.list_parent_indices(held).to_numpy(), pc.list_flatten(held).to_numpy()
    own, found = queries["row"].to_numpy(), []
    for number in np.unique(read):
        ours = kept[lists[kept] == number]
        x, size = points[ours], (points[ours] ** 2).sum(axis=1)
        readers = reader[read == number]
        for at in range(0, len(readers) if len(ours) else 0, ROWS):
            part = readers[at : at + ROWS]
            q = asked[part]
            about = (q * q).sum(axis=1)[:, None] + size - 2 * (q @ x.T)
            # One more than wanted, as the query itself may be there, and all that rounding could put behind it.
            last = np.partition(about, min(k, len(ours) - 1), axis=1)[:, min(k, len(ours) - 1)]
            slack = 1e-11 * ((q * q).sum(axis=1) + size.max())
            near, there = np.nonzero(about <= (last + slack)[:, None])
            near, there = part[near], ours[there]
            other = own[near] != rows[there]
            near, there = near[other], there[other]
            score = np.empty(len(near))
            for start in range(0, len(near), 8192):
                piece = slice(start, start + 8192)
                score[piece] = np.sqrt(((points[there[piece]] - asked[near[piece]]) ** 2).sum(axis=1))
            found.append((near, there, score))
    near, there, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
    near, there, score = np.asarray(near, np.int64), np.asarray(there, np.int64), np.asarray(score, np.float64)
    # A vector may be in several lists of the bundle.
    order = np.lexsort((place[there], score, near))
    near, there, score = near[order], there[order], score[order]
    _, once = np.unique(near * (len(points) + 1) + _first_of(rows, there), return_index=True)
    once.sort()
    near, there, score = near[once], there[once], score[once]
    starts = np.flatnonzero(np.r_[len(near) > 0, near[1:] != near[:-1]])
    rank = np.arange(len(near)) - np.repeat(starts, np.diff(np.r_[starts, len(near)]))
    near, there, score = near[rank < k], there[rank < k], score[rank < k]
    mine, theirs = queries.take(pa.array(near)), vectors.take(pa.array(there))
    return pa.table(
        {
            "query": mine["row"],
            "query_id": mine["id"],
            "row": theirs["row"],
            "vec_id": theirs["id"],
            "score": pa.array(score),
        }
    )


def _first_of(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for the row at each place, the same wherever that row stands in the bundle."""
    _, number = np.unique(rows, return_inverse=True)
    return number[places]


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found to each row with ``is_query`` (on ``key``)."""
    ours, dim = usable(df, key, vector)
    kind = ours.schema["id"].dataType.simpleString()
    schema = f"query long, query_id {kind}, row long, vec_id {kind}, score double"
    if not dim:
        empty = df.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    n = ours.count()
    index = fit(ours, min(MAX_LISTS, -(-n // LIST)), dim, n)
    listed = postings(ours, index, dim)
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for number, size in listed.groupBy("list").count().collect():
        sizes[number] = size
    first, parts = bundles(sizes)
    # As many rows as there are centroids.
    places = df.sparkSession.createDataFrame(
        [(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts, strict=True))],
        "list int, first long, parts long",
    )
    asked = ours.withColumnRenamed("id", key).filter(is_query).withColumnRenamed(key, "id")
    asked = _queries(asked.select("id", "v", "row"), index, sizes, dim, k)
    loads = asked.groupBy("bundle").agg(F.ceil(F.count("*") / QUERIES).alias("loads"))
    loads = materialize(loads, "loads")
    bundle = F.col("first") + F.pmod(F.xxhash64("row"), "parts")
    vectors = listed.join(F.broadcast(places), "list").withColumn("bundle", bundle).drop("first", "parts")
    vectors = vectors.join(loads, "bundle").withColumn("load", F.explode(F.sequence(F.lit(1).cast("long"), "loads"))).drop("loads")
    dealt = asked.join(loads, "bundle").withColumn("load", F.pmod(F.xxhash64("row"), "loads") + 1).drop("loads")

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        return scan(vectors, queries, dim, k)

    found = dealt.groupBy("bundle", "load").cogroup(vectors.groupBy("bundle", "load"))
    found = found.applyInArrow(search, schema)
    found = materialize(found, "found")
    discard(listed, asked, loads, ours)
    once = found.groupBy("query", "row").agg(
        *[F.first(c).alias(c) for c in ("query_id", "vec_id", "score")]
    )
    order = Window.partitionBy("query").orderBy("score", F.asc_nulls_last("vec_id"), "row")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
