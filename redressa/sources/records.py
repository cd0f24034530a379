"""Records of large quoted files, cut at their own line breaks by many tasks.

A line break inside quotes belongs to its record, so where a record begins depends on all quotes before it. But a
quote in a quoted field is doubled, so only the parity of their number counts: the parities of the blocks of a file are summed
up block by block (one small row each), and then every block knows whether it begins inside quotes and cuts its
lines into records by itself. A record that reaches over the end of its block leaves a piece in each block it touches; these
few pieces are put together by file.

Quotes must be written by the rules: only around whole fields, doubled inside them. A file with a lone quote between other
characters is named as irregular by :func:`block_parities`, and callers read it in another way.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redressa.session import materialize

# Blocks that the driver lists: 25 TB of them at the default size.
MAX_BLOCKS = 200_000

RECORD, HEAD, TAIL = 0, 1, 2

Parities = dict[str, dict[int, bool]]

# Workers need not have this package installed: its code travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def file_lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``file``, ``block`` (its first byte), ``row`` (ascending in a block) and the ``line``, without its line feed."""
    return spark.read.option("lineSep", "\n").text(list(files)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def block_parities(lines: DataFrame) -> tuple[Parities, set[str]] | None:
    """For each file, whether its blocks begin inside quotes; and the files with irregular quotes.

    None if there are more blocks than the driver should list.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    # A quote that neither a comma, nor an end of line, nor another quote is next to.
    lone = F.regexp_like("line", F.lit(r'[^",\r]"[^",\r]'))
    blocks = lines.groupBy("file", "block").agg(
        (F.sum(quotes) % 2).alias("odd"), F.max(lone.cast("int")).alias("lone")
    )
    rows = sorted(blocks.limit(MAX_BLOCKS + 1).collect())
    if len(rows) > MAX_BLOCKS:
        return None
    inside: Parities = {}
    irregular, odd = set(), False
    for row in rows:
        own = inside.setdefault(row["file"], {})
        odd = odd if own else False
        own[row["block"]] = odd
        odd ^= row["odd"] == 1
        if row["lone"]:
            irregular.add(row["file"])
    return inside, irregular


class _Cutter:
    """Cuts the lines of one block, given batch by batch, into records."""

    def __init__(self, file: str, block: int, inside: bool) -> None:
        self.file, self.block, self.inside = file, block, inside
        # Lines before the first end of a block that begins inside quotes are the rest of an earlier record.
        self.kind, self.first = (HEAD if inside else RECORD), block == 0
        self.held: list[str] = []
        self.held_row = 0

    def cut(self, rows: pa.Array, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        odd = (np.cumsum(quotes) + self.inside) % 2
        self.inside = bool(odd[-1])
        ends = np.flatnonzero(odd == 0) + 1
        if len(ends):
            starts = np.r_[0, ends[:-1]]
            own = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), lines.slice(0, ends[-1]))
            texts, numbers = pc.binary_join(own, "\n"), rows.to_numpy()[starts]
            if self.held:
                whole = "\n".join([*self.held, texts[0].as_py()])
                texts, numbers = pa.concat_arrays([pa.array([whole]), texts[1:]]), np.r_[self.held_row, numbers[1:]]
                self.held = []
            yield self._pieces(texts, numbers, np.r_[self.kind, np.full(len(ends) - 1, RECORD)])
            self.kind = RECORD
        rest = ends[-1] if len(ends) else 0
        if rest < len(lines):
            if not self.held:
                self.held_row = rows[int(rest)].as_py()
            self.held += lines[int(rest) :].to_pylist()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            kind = HEAD if self.kind == HEAD else TAIL
            yield self._pieces(pa.array(["\n".join(self.held)]), np.array([self.held_row]), np.array([kind]))

    def _pieces(self, texts: pa.Array, rows: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        first = np.zeros(len(kinds), dtype=bool)
        first[0], self.first = self.first, False
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.repeat(self.file, len(kinds)),
                "block": pa.repeat(pa.scalar(self.block, pa.int64()), len(kinds)),
                "row": pa.array(rows, pa.int64()),
                "kind": pa.array(kinds, pa.int32()),
                "first": first,
                "record": texts,
            }
        )


def file_records(lines: DataFrame, inside: Parities) -> DataFrame:
    """``file``, ``block``, ``row`` and ``record``, without line end, of every record but the first of each file.

    Blank lines between records are no records. The records are written once, for the blocks of a file could be cut
    elsewhere when it is scanned again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for batch in batches:
            files = batch.column("file").dictionary_encode()
            blocks, codes = batch.column("block").to_numpy(), files.indices.to_numpy()
            changes = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
            for start, end in zip([0, *changes.tolist()], [*changes.tolist(), len(blocks)], strict=True):
                if start == end:
                    continue
                file, block = files.dictionary[int(codes[start])].as_py(), int(blocks[start])
                if cutter is None or (cutter.file, cutter.block) != (file, block):
                    if cutter:
                        yield from cutter.close()
                    if block not in inside.get(file, {}):
                        raise ValueError("the blocks of a file changed between two scans; read it again")
                    cutter = _Cutter(file, block, inside[file][block])
                yield from cutter.cut(batch.column("row")[start:end], batch.column("line")[start:end])
        if cutter:
            yield from cutter.close()

    schema = "file string, block long, row long, kind int, first boolean, record string"
    pieces = materialize(lines.mapInArrow(run, schema), "pieces")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    part = F.struct("block", "kind", "record", "row", "first")
    joined = (
        pieces.filter(F.col("kind") != RECORD)
        .withColumn("number", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select(
            "file",
            F.col("parts")[0]["block"].alias("block"),
            F.col("parts")[0]["row"].alias("row"),
            F.col("parts")[0]["first"].alias("first"),
            F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
        )
    )
    every = pieces.filter(F.col("kind") == RECORD).select(*joined.columns).unionByName(joined)
    record = F.regexp_replace("record", "\r$", "")
    return every.filter(~F.col("first")).select("file", "block", "row", record.alias("record")).filter("record <> ''")
