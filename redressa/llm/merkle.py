"""Merkle dataset manifest: a persistent tree of digests, copied along the path of each change.

Every document is a leaf, each language has a tree over its leaves in order of doc_id, and one tree over the
languages' roots gives the root of the dataset. Eight consecutive nodes make one above. A changed leaf makes a
version of the tree that shares all nodes the change leaves alone and copies only those over the leaf.

Leaves are hashed in the scan, the only step that reads texts. Places come from a range partitioning by
(language, doc_id, digest): its tasks number their rows, and the rows of each language in the tasks before are added, so
no task orders a whole language. A tree is then cut into aligned blocks of ``8 ** 4`` nodes: every level of a block
lies within it, a task builds it by itself, and its root is a node of the next round. Rounds go on until one
node remains, three for 68 billion leaves. On the way down, each block gets its path to the root (the siblings on each
level), so versions are made in parallel, block by block: copied inside the block, then along the path over it.
All versions meet in the upper nodes, but none of them is sent there.

Defined results: null values are hashed as ``-``; languages go null first, then by UTF-8 bytes; a null doc_id comes first
in its language and is not tampered with; rows with equal doc_id go by digest, and equal rows are leaves of
their own. Other columns are not read. An empty table has no root and gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.session import discard, materialize

FANOUT = 8
BLOCK = FANOUT**4

_HEX = 64

# Workers need not have this package installed: its code travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def leaf_digest(*fields: Column) -> Column:
    """Binary SHA-256 of the fields: ``-`` for null, else byte count, ``:`` and value."""
    values = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def lower_third(doc_id: Column, text: Column) -> Column:
    """The tampered text of a third of the documents, by checksum of doc_id: A-Z in lower case."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(text)


def leaves(docs: DataFrame, tamper: Callable[[Column, Column], Column] = lower_third) -> DataFrame:
    """``tree``, ``doc_id``, ``digest`` and, where tampering changes it, ``changed`` of every row."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text, other = F.col("text"), tamper(F.col("doc_id"), F.col("text"))
    same = other.eqNullSafe(text)
    return docs.select(
        # Sorts null before all languages.
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        "doc_id",
        leaf_digest(*own, text).alias("digest"),
        F.when(~same, leaf_digest(*own, other)).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position`` in their tree (from 0) by ``order``, and ``n``, the rows of the tree."""
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # The upper bits are the task, the lower 33 the row in it.
    ordered = materialize(ordered.withColumn("serial", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("serial", 33).alias("task")
    counts = ordered.groupBy("tree", task).agg(F.min("serial").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree",
        "task",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("start"),
        F.sum("rows").over(whole).alias("n"),
    )
    joined = ordered.withColumn("task", task).join(starts, ["tree", "task"])
    found = joined.select(*rows.columns, (F.col("serial") + F.col("start")).alias("position"), "n")
    found = materialize(found, "placed")
    discard(ordered)
    return found


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def _depth(n: int) -> int:
    """Levels that a block builds over its nodes, in a tree of ``n`` of them."""
    depth, reach = 0, 1
    while reach < min(n, BLOCK):
        depth, reach = depth + 1, reach * FANOUT
    return depth


def _runs(level: list[str]) -> list[str]:
    return ["".join(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]


def _tree(digests: list[str], n: int) -> tuple[list[list[str]], str]:
    """The runs of each level of a block, as joined digests, and the block's root."""
    levels, level = [], digests
    for _ in range(_depth(n)):
        levels.append(_runs(level))
        level = [_hash(run) for run in levels[-1]]
    return levels, level[0]


def _path(levels: list[list[str]], at: int) -> list[tuple[int, str]]:
    """(place in its run, siblings) of node ``at`` and of each node over it in the block."""
    steps = []
    for runs in levels:
        at, place = divmod(at, FANOUT)
        run = runs[at]
        steps.append((place, run[: place * _HEX] + run[(place + 1) * _HEX :]))
    return steps


def _copied(leaf: str, steps: list[tuple[int, str]]) -> list[str]:
    """The nodes over a leaf, up to the root, with that leaf in their runs."""
    nodes, node = [], leaf
    for place, siblings in steps:
        node = _hash(siblings[: place * _HEX] + node + siblings[place * _HEX :])
        nodes.append(node)
    return nodes


def _packed(steps: list[tuple[int, str]]) -> str:
    return ",".join(f"{place}:{siblings}" for place, siblings in steps)


def _unpacked(path: str) -> list[tuple[int, str]]:
    steps = (step.split(":") for step in path.split(",") if step)
    return [(int(place), siblings) for place, siblings in steps]


def _block() -> Column:
    return F.floor(F.col("position") / BLOCK).alias("block")


def _block_roots(nodes: DataFrame) -> DataFrame:
    """The nodes of the next round: one per block."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        n = int(rows["n"].iloc[0])
        _, root = _tree([d.hex() for d in rows["digest"]], n)
        return pd.DataFrame(
            {"tree": [key[0]], "position": [key[1]], "digest": [bytes.fromhex(root)], "n": [-(-n // BLOCK)]}
        )

    blocks = nodes.select("tree", "position", "digest", "n").groupBy("tree", _block())
    return blocks.applyInPandas(build, "tree string, position long, digest binary, n long")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes themselves, and the block roots of each round until every tree has one node."""
    rounds = [nodes]
    while not rounds[-1].filter("n > 1").isEmpty():
        rounds.append(materialize(_block_roots(rounds[-1]), "nodes"))
    return rounds


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``path``, ``subroot`` and ``root`` of each node, from those of its block."""

    def extend(key: tuple, rows: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        levels, _ = _tree([d.hex() for d in rows["digest"]], int(rows["n"].iloc[0]))
        rest = _unpacked(over["path"].iloc[0])
        paths = [_packed(_path(levels, at) + rest) for at in range(len(rows))]
        return pd.DataFrame(
            {
                "tree": key[0],
                "position": rows["position"],
                "path": paths,
                "subroot": over["subroot"].iloc[0],
                "root": over["root"].iloc[0],
            }
        )

    below = nodes.select("tree", "position", "digest", "n").groupBy("tree", _block())
    over = above.groupBy("tree", "position")
    return below.cogroup(over).applyInPandas(
        extend, "tree string, position long, path string, subroot string, root string"
    )


def block_paths(rounds: list[DataFrame]) -> DataFrame:
    """``tree``, ``position``, ``path``, ``subroot``, ``root`` of the blocks of leaves."""
    subroots = rounds[-1].select("tree", "digest")
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest")
    tops = _rounds(placed(top, "language"))
    paths = tops[-1].select(
        "tree",
        F.lit(0).cast("long").alias("position"),
        F.lit("").alias("path"),
        F.lit("").alias("subroot"),
        F.lower(F.hex("digest")).alias("root"),
    )
    for nodes in reversed(tops):
        paths = materialize(_paths(nodes, paths), "paths")
    languages = tops[0].select("position", "language", "digest")
    paths = paths.join(languages, "position").select(
        F.col("language").alias("tree"),
        F.lit(0).cast("long").alias("position"),
        "path",
        F.lower(F.hex("digest")).alias("subroot"),
        "root",
    )
    for nodes in reversed(rounds[1:]):
        paths = materialize(_paths(nodes, paths), "paths")
    return paths


def manifest(docs: DataFrame, tamper: Callable[[Column, Column], Column] = lower_third) -> DataFrame:
    """Each row's leaf with its proof, and its version of the tree if it was tampered with.

    ``doc_id``, ``leaf``, ``subroot``, ``root``, ``siblings`` (of the untampered tree, leaf to root, joined), ``proof_sha256``,
    ``copied`` (the nodes that the row's version does not share, from the leaf's parent to the new root;
    null where the leaf is unchanged), ``folded_root`` and ``verified``.
    """
    written = materialize(leaves(docs, tamper), "leaves")
    nodes = placed(written, "doc_id", "digest", "row")
    discard(written)
    paths = block_paths(_rounds(nodes))
    kind = nodes.schema["doc_id"].dataType

    def version(key: tuple, rows: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        digests = [d.hex() for d in rows["digest"]]
        levels, _ = _tree(digests, int(rows["n"].iloc[0]))
        rest, root = _unpacked(over["path"].iloc[0]), over["root"].iloc[0]
        found = []
        for at, (leaf, changed) in enumerate(zip(digests, rows["changed"], strict=True)):
            steps = _path(levels, at) + rest
            siblings = "".join(s for _, s in steps)
            nodes_over = _copied(changed.hex() if changed else leaf, steps)
            folded = nodes_over[-1] if nodes_over else (changed.hex() if changed else leaf)
            found.append((leaf, siblings, _hash(siblings), nodes_over if changed else None, folded, folded == root))
        columns = ["leaf", "siblings", "proof_sha256", "copied", "folded_root", "verified"]
        table = pd.DataFrame(found, columns=columns)
        table["doc_id"] = rows["doc_id"].to_numpy()
        return table.assign(subroot=over["subroot"].iloc[0], root=root)

    below = nodes.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("tree", _block())
    over = paths.groupBy("tree", "position")
    schema = (
        "doc_id string, leaf string, subroot string, root string, siblings string, proof_sha256 string, "
        "copied array<string>, folded_root string, verified boolean"
    )
    found = below.cogroup(over).applyInPandas(version, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
