"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of 64 bits are made from hashed word shingles; two texts are linked when
their fingerprints differ in at most two bits, and a group is what links connect.

Search. Bits are put into parts, correlated bits together, and each part gets a
threshold of its own (-1 skips the part) with sum ``distance - parts + 1``: then any
linked pair is within the threshold of at least one part. A dynamic programme picks the
thresholds, and a comparison over part counts the layout, with the least estimated
work: the probe rows a threshold costs and the candidates it is expected to bring,
counted on a bounded sample of fingerprints. The sample only steers cost; any layout
gives the same links.

Only distinct fingerprints take part (copies meet in one row by a pre-aggregated
group-by). A bucket of at most ``BUCKET_CAP`` fingerprints is probed pair by pair, and
each pair is verified on all bits. Members of a larger bucket take an exact other way
that makes no pairs: each sends itself to its 65 neighbours at distance 0 and 1; two
fingerprints are within two bits exactly when they share such a neighbour, so a star to the
smallest fingerprint at each neighbour has the same connected groups.

Groups come from rounds of label passing along links and label jumping, on written
tables, so that no round depends on executors that are gone.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any
other. Repeated rows share a fingerprint. A null doc_id is never the smallest of a group
unless all are null. Columns other than ``doc_id`` and ``text`` are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.llm.common import map_rows
from redressa.session import discard, materialize

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
SAMPLE = 4096
BUCKET_CAP = 32
ROWS_AT_ONCE = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number.

    ``bytes.split`` and ``bytes.lower`` know ASCII only, which is the definition.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, ROWS_AT_ONCE):
        some = words[at : at + ROWS_AT_ONCE + k - 1]
        hashes = np.fromiter(
            (digest(joined(s), SEED) for s in zip(*(some[i:] for i in range(k)), strict=False)),
            dtype=">u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "fp": np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.int64),
                }
            )

    return map_rows(docs.select("doc_id", "text"), "doc_id", run, "fp long")


# ---- layout ---------------------------------------------------------------------------


def _grouped_bits(matrix: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of even size, each grown by the most correlated bit."""
    spread = matrix.std(axis=0)
    centred = (matrix - matrix.mean(axis=0)) / np.where(spread > 0, spread, 1)
    correlation = np.abs(centred.T @ centred) / max(len(matrix), 1)
    left, groups = list(range(BITS)), []
    for g in range(parts):
        size = len(left) // (parts - g)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (correlation[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _variants(width: int, threshold: int) -> list[tuple[int, ...]]:
    return [c for t in range(threshold + 1) for c in combinations(range(width), t)]


def _thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one a part, with the given sum (dynamic programme)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for so_far, (spent, chosen) in best.items():
            for threshold, price in cost.items():
                key, new = so_far + threshold, (spent + price, [*chosen, threshold])
                if key not in following or new < following[key]:
                    following[key] = new
        best = following
    return best[total]


def plan_parts(sample: np.ndarray, rows: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each part, for ``rows`` fingerprints like ``sample``."""
    matrix = ((sample[:, None].astype(np.uint64) >> np.arange(BITS, dtype=np.uint64)) & 1).astype(float)
    best = None
    for parts in range(1, distance + 2):
        groups = _grouped_bits(matrix, parts)
        costs = []
        for bits in groups:
            own = matrix[:, bits]
            apart = own @ (1 - own).T
            apart = apart + apart.T
            np.fill_diagonal(apart, BITS)
            near = [(apart <= t).mean() if len(sample) > 1 else 0.0 for t in range(distance + 1)]
            # A part this wide has collisions too rare for the sample to show.
            chance = [len(_variants(len(bits), t)) / 2.0 ** len(bits) for t in range(distance + 1)]
            costs.append(
                {-1: 0.0}
                | {
                    t: len(_variants(len(bits), t)) + rows * max(near[t], chance[t])
                    for t in range(distance + 1)
                }
            )
        spent, chosen = _thresholds(costs, distance - parts + 1)
        if best is None or spent < best[0]:
            best = (spent, list(zip(groups, chosen, strict=True)))
    return best[1]


# ---- links ----------------------------------------------------------------------------


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), dtype=np.uint64).astype(np.int64))


def _probe_keys(layout: list[tuple[list[int], int]], fp: Column) -> Column:
    """Array of (part, value of its bits, own): own values and those nearby."""
    keys = []
    for number, (bits, threshold) in enumerate(layout):
        masked = fp.bitwiseAND(F.lit(_mask(bits)))
        for flips in _variants(len(bits), threshold) if threshold >= 0 else []:
            key = masked.bitwiseXOR(F.lit(_mask([bits[f] for f in flips]))) if flips else masked
            keys.append(F.struct(F.lit(number).alias("part"), key.alias("value"), F.lit(not flips).alias("own")))
    return F.array(*keys)


def links(fps: DataFrame, distance: int = DISTANCE, cap: int = BUCKET_CAP) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints whose groups are those of all
    pairs within ``distance`` bits. ``fps`` is a written table with a column ``fp``."""
    sample = np.array(
        [r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()],
        dtype=np.int64,
    )
    layout = plan_parts(sample, fps.count(), distance)
    probes = fps.select("fp", F.explode(_probe_keys(layout, F.col("fp"))).alias("k")).select(
        "k.part", "k.value", "fp", "k.own"
    )
    sizes = probes.groupBy("part", "value").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("owners")
    )
    shared = materialize(sizes.filter("n > 1 AND owners > 0"), "simhash-buckets")
    small = probes.join(shared.filter(F.col("n") <= cap).select("part", "value"), ["part", "value"])
    owners = small.filter("own").select("part", "value", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance
    pairs = (
        owners.join(small.drop("own"), ["part", "value"])
        .filter((F.col("a") != F.col("fp")) & near)
        .select(F.greatest("a", "fp").alias("a"), F.least("a", "fp").alias("b"))
    )
    crowded = (
        probes.join(shared.filter(F.col("n") > cap).select("part", "value"), ["part", "value"])
        .select("fp")
        .distinct()
    )
    return pairs.union(_stars(crowded, distance)).distinct()


def _stars(fps: DataFrame, distance: int) -> DataFrame:
    """Links over shared neighbours: exact for two bits, with 65 rows a fingerprint."""
    if distance != 2:
        raise ValueError("crowded buckets are resolved for a distance of two bits")
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS)])
    spokes = fps.select("fp", F.explode(around).alias("hub"))
    least = spokes.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return (
        spokes.join(least.select("hub", "b"), "hub")
        .filter("fp <> b")
        .select(F.col("fp").alias("a"), "b")
        .distinct()
    )


# ---- groups ---------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of each connected group with a link.

    Every round hangs a node's neighbours that are larger than it under its smallest
    neighbour, then its smaller ones (large star, small star), until nothing moves. Rows never
    exceed the links, and both stars pre-aggregate their minimum.
    """
    current = materialize(edges.select("a", "b").filter("a > b").distinct(), "links")
    mark = _mark(current)
    while True:
        following = materialize(_small_star(_large_star(current)), "links")
        discard(current)
        current, before, mark = following, mark, _mark(following)
        if mark == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    """Count and 64-bit digest of a set of links, to see whether a round changed it."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(near: DataFrame, with_self: bool) -> DataFrame:
    """Each (x, y) with ``m``, the smallest y of its x (or x itself). The minima are
    written first, so that both sides of the join are plain exchanges and a hub with
    very many neighbours can be split at run time."""
    least = near.groupBy("x").agg(F.min("y").alias("m"))
    if with_self:
        least = least.withColumn("m", F.least("x", "m"))
    return near.join(materialize(least, "least"), "x")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(
        edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
    )
    return (
        _with_least(both, True)
        .filter("y > x")
        .select(F.col("y").alias("a"), F.col("m").alias("b"))
        .filter("a > b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    linked = _with_least(down, False)
    return (
        linked.select(F.col("y").alias("a"), F.col("m").alias("b"))
        .union(linked.select(F.col("x").alias("a"), F.col("m").alias("b")))
        .filter("a > b")
        .distinct()
    )


# ---- operator -------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest doc_id reachable by links."""
    rows = materialize(fingerprints(docs, shingle), "simhash")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    groups = materialize(components(links(fps, distance)), "simhash-groups")
    # Only fingerprints with a link are in ``groups``; a group's first doc_id is the
    # smallest of its members' and its root's.
    member = fps.join(groups, fps["fp"] == groups["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    first = member.groupBy("root").agg(F.min("first").alias("component_id"))
    label = materialize(member.join(first, "root").select("fp", "component_id"), "simhash-labels")
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` that are first in their group, with their own columns.

    Rows with one doc_id share a verdict; a null doc_id stays, as nothing names it.
    """
    found = near_duplicates(docs, shingle, distance)
    later = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(later, docs["doc_id"] == later["_id"], "left_anti")
