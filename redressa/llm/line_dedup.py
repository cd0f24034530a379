"""Line dedup: a suffix array over line ids, built by distributed prefix doubling.

The corpus is read as one sequence of lines (documents in order of doc_id, then of
their text's hash). A run of lines is a later copy if an equal run starts at an earlier position; every
line in a later copy of ``min_words`` words or more is deleted.

Round k of the doubling holds, for each position, the class of the block of ``2^k`` lines from there; round k + 1 names
the pairs (class here, class ``2^k`` lines on), never across the end of a document. A class with two or more members is an
interval of the suffix array whose longest common prefix is at least ``2^k`` lines; positions alone in their class have no
equal run of that length and leave the work. A block of any length L is named by the classes of its first and of its last
``2^k`` lines, which overlap, for the largest ``2^k`` up to L.

Not all lengths need a look. From each position, take the shortest block with ``min_words`` words, and the longer ones that end before the
shortest block of the next position does: together at most two blocks a line. A longer block contains the next position's shortest
one, so if it is a later copy, it is covered by blocks that are looked at and are later copies too. Hence the maximal repeated
runs are found exactly, and the doubling ends at the longest of these blocks, not at the longest repeat.

Everything is DataFrame functions. A class is named by its first position, found by a
group-by with map-side combine; the named classes are written, and joined back by plain
exchanges which can be split at run time when one class is very common. Windows go over one document's lines, the unit
that is one row on input. Lines travel as digests; the text moves once, to meet its deletions.

Defined results: a null text stays null and has no lines; an empty text has one empty
line. Rows with equal doc_id and text are one document to the search and share the
verdict; a null doc_id comes first in the order. Blank lines count as lines with no words,
so they only go inside a repeated run. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.llm.common import free_name, words_of
from redressa.session import discard, materialize

MIN_WORDS = 10


def _lines(docs: DataFrame) -> DataFrame:
    """``doc`` (doc_id, hash of the text), ``at``, ``line`` (digest), ``words``."""
    doc = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return (
        docs.filter("text IS NOT NULL")
        .select(doc.alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
        .select(
            "doc",
            "at",
            F.unhex(F.md5("text")).alias("line"),
            F.size(words_of(F.col("text"))).cast("long").alias("words"),
        )
    )


def _position() -> Column:
    return F.struct("doc", "at")


def _intervals(rows: DataFrame, *key: str) -> DataFrame:
    """Classes with two positions or more, named by the first of them."""
    found = rows.groupBy(*key).agg(
        F.min(_position()).alias("first"), F.max(_position()).alias("last")
    )
    return materialize(found.filter("first <> last").drop("last"), "intervals")


def _after(column: str, lines: int) -> Column:
    """Value of ``column`` in the row of the same document ``lines`` further on."""
    ahead = Window.partitionBy("doc").orderBy("at").rangeBetween(lines, lines)
    return F.first(column).over(ahead)


def _blocks(lines: DataFrame, min_words: int) -> DataFrame:
    """``doc``, ``at``, ``size`` of the blocks that decide: see above."""
    document = Window.partitionBy("doc").orderBy("at")
    before = F.sum("words").over(document) - F.col("words")
    counted = lines.select("doc", "at", "words", before.alias("before"))
    # The position after the last line ends blocks, but begins none.
    after = counted.groupBy("doc").agg(
        (F.max("at") + 1).alias("at"), F.lit(0).cast("long").alias("words"), F.sum("words").alias("before")
    )
    every = counted.unionByName(after)
    # A block may end where the words before are its own first and min_words: in descending order, the last end seen.
    ends = every.select("doc", F.col("before").alias("place"), F.lit(0).alias("kind"), "at")
    starts = counted.select("doc", (F.col("before") + max(min_words, 1)).alias("place"), F.lit(1).alias("kind"), "at")
    down = Window.partitionBy("doc").orderBy(F.desc("place"), "kind", F.desc("at"))
    seen = F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True)
    shortest = (
        ends.unionByName(starts)
        .withColumn("end", seen.over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("kind = 1")
        .select("doc", "at", "end")
    )
    length = F.max("at").over(Window.partitionBy("doc")) + 1
    following = F.coalesce(F.lead("end").over(document) - 1, length)
    spans = shortest.select("doc", "at", "end", F.greatest(F.col("end"), following).alias("last"))
    sizes = F.sequence(F.col("end") - F.col("at"), F.col("last") - F.col("at"))
    return spans.filter("end IS NOT NULL").select("doc", "at", F.explode(sizes).alias("size"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc``, ``at``, ``end``: runs of lines that are later copies.

    Every repeated line is there too, with ``end = at``.
    """
    lines = materialize(_lines(docs), "lines")
    named = _intervals(lines, "line")
    active = materialize(
        lines.join(named, "line").select("doc", "at", F.col("first").alias("class")), "active"
    )
    # A block begins and ends with repeated lines, or it has no copy.
    edge = active.select("doc", "at")
    wanted = _blocks(lines, min_words).join(edge, ["doc", "at"], "left_semi")
    wanted = wanted.withColumn("to", F.col("at") + F.col("size") - 1)
    edge = edge.withColumnRenamed("at", "to")
    wanted = materialize(wanted.join(edge, ["doc", "to"], "left_semi").drop("to"), "blocks")
    discard(named, lines)
    longest = wanted.agg(F.max("size")).first()[0] or 0
    runs, size = [active.select("doc", "at", F.col("at").alias("end"))], 1
    while size <= longest:
        runs.append(_copies(wanted.filter(F.col("size").between(size, 2 * size - 1)), active, size))
        if 2 * size > longest:
            break
        paired = active.select(
            "doc",
            "at",
            F.col("class").alias("head"),
            _after("class", size).alias("tail"),
        ).filter("tail IS NOT NULL")
        paired = materialize(paired, "pairs")
        named = _intervals(paired, "head", "tail")
        active = materialize(
            paired.join(named, ["head", "tail"]).select("doc", "at", F.col("first").alias("class")), "active"
        )
        discard(paired, named)
        if active.isEmpty():
            break
        size *= 2
    discard(wanted)
    found = runs[0]
    for more in runs[1:]:
        found = found.union(more)
    return found


def _copies(blocks: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``doc``, ``at``, ``end`` of the blocks of ``size`` to ``2 size - 1`` lines that are later copies."""
    head = classes.withColumnRenamed("class", "head")
    tail = classes.select("doc", F.col("at").alias("late"), F.col("class").alias("tail"))
    paired = blocks.withColumn("late", F.col("at") + F.col("size") - size)
    if size == 1:
        paired = paired.join(head, ["doc", "at"]).withColumn("tail", F.col("head"))
    else:
        paired = paired.join(head, ["doc", "at"]).join(tail, ["doc", "late"])
    paired = materialize(paired.select("doc", "at", "size", "head", "tail"), "named")
    named = _intervals(paired, "size", "head", "tail")
    found = paired.join(named, ["size", "head", "tail"]).filter(F.col("first") != _position())
    found = materialize(found.select("doc", "at", (F.col("at") + F.col("size")).alias("end")), "copies")
    discard(paired, named)
    return found


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc`` and ``gone``, the numbers of its lines that are deleted."""
    # Each line of a block is a repeated line itself and so has a row: it goes when a block
    # from here or before reaches over it.
    before = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    blocks = repeated_runs(docs, min_words).groupBy("doc", "at").agg(F.max("end").alias("end"))
    gone = blocks.withColumn("reach", F.max("end").over(before)).filter("reach > at")
    return gone.groupBy("doc").agg(F.collect_list("at").alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` rid of later copies, and ``n_lines`` and ``n_removed``."""
    counts = [free_name(docs.columns, c) for c in ("n_lines", "n_removed")]
    gone = deleted_lines(docs.select("doc_id", "text"), min_words)
    gone = gone.select(F.col("doc.id").alias("_id"), F.col("doc.hash").alias("_hash"), "gone")
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    joined = docs.select(*[docs[f"`{c}`"] for c in docs.columns]).join(gone, same, "left")
    lines = F.split(docs["text"], "\n")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(
        F.transform(F.array_except(every, gone["gone"]), lambda i: F.get(lines, i)), "\n"
    )
    text = F.when(gone["gone"].isNull(), docs["text"]).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c.lower() == "text" else docs[f"`{c}`"] for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size(gone["gone"]), F.lit(0)).cast("long").alias(counts[1]),
    )


def keep_new_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of line runs deleted; documents that this leaves without
    a word go, as nothing of them is new."""
    found = line_dedup(docs, min_words)
    removed = found.columns[-1]
    empty = (F.col(removed) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.filter(~empty).select(*[F.col(f"`{c}`") for c in docs.columns])
