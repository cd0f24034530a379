"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text; a chunk ends where the hash of the
last ``WINDOW`` bytes has its top bits zero, so cuts depend on nearby content only and
come again after an insertion as soon as the window is past it. Chunks are compared by a
128-bit digest. The first place of a digest (in order of doc_id, then position) stays; a later
one is a copy, and a stretch of adjacent copies of ``MIN_RUN`` bytes or more is a
repeated span, which is removed. Shorter stretches are common phrases and stay.

Scale: the digests are made twice instead of being stored. The first pass counts their
first halves (16 bytes a row, summed on the map side); the second lets only chunks
of counted repeats through, by a join whose sides are plain exchanges, so a very common
chunk can be split at run time. What follows (exact digests, first places, stretches) works on
repeated chunks alone. Stretches are found in a window over one document.

Defined results: null and empty texts have no chunk. Equal rows (doc_id and text) are one
document and share the verdict. A null doc_id comes first in the order. Offsets count
code points, and a character is never cut. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redressa.llm.common import free_name, map_rows
from redressa.session import materialize

WINDOW = 16
CUT_BITS = 4
MIN_CHUNK = 12
MAX_CHUNK = 512
MIN_RUN = 128
ROWS_AT_ONCE = 150_000
SLICE = 1 << 22

_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], dtype=np.uint16)


def _cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of the places where a chunk may end, by content alone."""
    found = []
    for low in range(0, len(data), SLICE):
        part = data[max(0, low - WINDOW) : low + SLICE]
        rolled = _GEAR[part]
        step = 1
        while step < WINDOW:
            rolled[step:] += rolled[:-step] << np.uint16(step)
            step *= 2
        ends = np.flatnonzero(rolled >> np.uint16(16 - CUT_BITS) == 0) + 1 + max(0, low - WINDOW)
        found.append(ends[ends > low])
    ends = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    inner = ends[ends < len(data)]
    return inner[(data[inner] & 0xC0) != 0x80]


def chunk_ends(data: bytes) -> list[int]:
    """Byte ends of the chunks; the last is the end of the text."""
    view = np.frombuffer(data, dtype=np.uint8)
    ends, last = [], 0
    for end in [*_cut_points(view).tolist(), len(data)]:
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            while view[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if end - last >= MIN_CHUNK or (end == len(data) and end > last):
            ends.append(end)
            last = end
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``start``, ``end`` (bytes), ``d1``, ``d2`` of every chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = (text or "").encode()
                ends = chunk_ends(data)
                if ends:
                    starts = [0, *ends[:-1]]
                    digests = b"".join([digest(data[a:b]) for a, b in zip(starts, ends, strict=True)])
                    held.append((doc_id, _signed(xxhash.xxh64_intdigest(data, 42)), starts, ends, digests))
                    size += len(ends)
                if size >= ROWS_AT_ONCE:
                    yield _table(held)
                    held, size = [], 0
            if held:
                yield _table(held)

    schema = "text_hash long, start int, end int, d1 long, d2 long"
    return map_rows(docs.select("doc_id", "text"), "doc_id", run, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _table(held: list[tuple]) -> pd.DataFrame:
    counts = [len(h[2]) for h in held]
    ids = pd.Series([h[0] for h in held]).repeat(counts).reset_index(drop=True)
    digests = np.frombuffer(b"".join(h[4] for h in held), dtype="<i8").reshape(-1, 2)
    return pd.DataFrame(
        {
            "doc_id": ids,
            "text_hash": np.repeat(np.array([h[1] for h in held], dtype=np.int64), counts),
            "start": np.concatenate([np.array(h[2], dtype=np.int32) for h in held]),
            "end": np.concatenate([np.array(h[3], dtype=np.int32) for h in held]),
            "d1": digests[:, 0],
            "d2": digests[:, 1],
        }
    )


def repeated_spans(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id``, ``text_hash``, ``start``, ``end`` (bytes) and ``first_doc_ids`` of each span."""
    every = chunks(docs)
    often = materialize(
        every.groupBy("d1").agg(F.count("*").alias("n")).filter("n > 1").select("d1"), "digests"
    )
    repeats = materialize(every.join(often, "d1", "left_semi").distinct(), "chunks")
    place = F.struct("doc_id", "text_hash", "start")
    first = materialize(repeats.groupBy("d1", "d2").agg(F.min(place).alias("first")), "first")
    copies = repeats.join(first, ["d1", "d2"]).filter(F.col("first") != place)
    doc = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    apart = F.coalesce((F.lag("end").over(doc) != F.col("start")).cast("int"), F.lit(1))
    numbered = copies.withColumn("apart", apart).withColumn("run", F.sum("apart").over(doc))
    return (
        numbered.groupBy("doc_id", "text_hash", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sort_array(F.collect_set("first.doc_id")).alias("first_doc_ids"),
        )
        .filter(F.col("end") - F.col("start") >= min_run)
        .drop("run")
    )


def substring_dedup(docs: DataFrame, min_run: int = MIN_RUN, changed_only: bool = False) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``.

    Adds ``n_removed`` (code points), ``spans`` (start, end of each removed span in code
    points of the old text) and ``first_doc_ids`` (where the text was first).
    """
    names = [free_name(docs.columns, c) for c in ("n_removed", "spans", "first_doc_ids")]
    own_id, own_hash, own_cuts, own_first = (
        free_name(docs.columns, c) for c in ("_id", "_hash", "_cuts", "_first")
    )
    found = (
        repeated_spans(docs.select("doc_id", "text"), min_run)
        .groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "end"))).alias(own_cuts),
            F.array_distinct(F.flatten(F.collect_list("first_doc_ids"))).alias(own_first),
        )
    )
    same = docs["doc_id"].eqNullSafe(found[own_id]) & (F.xxhash64(docs["text"]) == found[own_hash])
    joined = docs.join(found, same, "inner" if changed_only else "left")
    # Under a name of its own: a lambda would take the new text for "text".
    old = free_name(docs.columns, "_old")
    joined = joined.withColumn(old, docs["text"])
    cuts, data = F.col(own_cuts), F.col(old).cast("binary")

    def piece(low, high):
        return F.substring(data, low + 1, high - low).cast("string")

    kept = F.concat(
        F.array_join(
            F.transform(
                cuts,
                lambda c, i: piece(F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"]), c["start"]),
            ),
            "",
        ),
        piece(F.element_at(cuts, -1)["end"], F.octet_length(old)),
    )
    spans = F.transform(
        cuts,
        lambda c: F.struct(
            F.length(piece(F.lit(0), c["start"])).cast("long").alias("start"),
            F.length(piece(F.lit(0), c["end"])).cast("long").alias("end"),
        ),
    )
    text = F.when(cuts.isNull(), F.col(old)).otherwise(kept)
    removed = F.coalesce(F.length(old) - F.length(text), F.lit(0)).cast("long")
    return joined.select(
        *[text.alias(c) if c.lower() == "text" else docs[f"`{c}`"] for c in docs.columns],
        removed.alias(names[0]),
        spans.alias(names[1]),
        F.col(own_first).alias(names[2]),
    )
