"""Source divergence audit: how far the word use of each source is from the other sources of its language.

An Arrow pipeline counts terms inside ``mapInArrow``: A-Z lowered, texts split at what is not part of a term, terms
and groups encoded as numbers, and two hash group-bys (terms of a document, terms of a group). A task merges what it has
counted whenever that grows beyond ``HELD`` rows, so its memory depends neither on the rows nor on the length of the input. Spark adds
the partial counts, partly before the exchange, so a word or source with a third of all uses costs no more than others.

Each language keeps the terms in at least ``MIN_DOCS`` of its documents. A group (language and source) gives a kept term the share
``p = 1 + floor(1e9 (count + 5) / (N + 5 V))``, whole numbers throughout. A pair of sources is as far apart as the
sum of ``|p - q|`` over all kept terms; a source's own terms are those that it gives more than its language does, by ``p - q``.
Kept counts are dealt by term into shards of a bounded number of cells (terms times sources of the language); a task makes a
dense table of one shard, adds up its pairs and picks its highest terms, and Spark merges shards. The work for pairs is that of the
result: sources times sources times terms, spread over the shards.

Defined results: null text, language or source count as ``''``; each row is a document, equal rows too; a group without terms
is still compared, and a language without kept terms has pairs of value 0. Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redressa.session import discard, materialize

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50

# A run of characters that no term has: ASCII other than letters.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

SLICE = 4 << 20
HELD = 400_000
# Cells of a shard: as many as the pairs it returns, within these bounds.
LEAST_CELLS, CELLS = 1 << 16, 1 << 22

# Workers need not have this package installed: its code travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """``batch`` with null as ``''``, in pieces of about ``SLICE`` bytes of text (or one row)."""
    filled = pa.table({c: pc.fill_null(batch.column(c), "") for c in ("lang", "source", "text")})
    ends = np.cumsum(pc.binary_length(filled["text"]).to_numpy())
    cuts = np.flatnonzero(np.diff(ends // SLICE)) + 1
    for start, end in zip((0, *cuts), (*cuts, len(ends)), strict=True):
        if end > start:
            yield filled.slice(start, end - start)


def count_terms(rows: pa.Table) -> pa.Table:
    """``lang``, ``source``, ``term``, ``n`` uses in ``docs`` rows; each group also has a term ``''`` without uses."""
    text = pc.ascii_lower(rows["text"].combine_chunks())
    terms = pc.split_pattern_regex(text, pattern=SEPARATORS)
    row, flat = pc.list_parent_indices(terms), pc.list_flatten(terms)
    real = pc.not_equal(flat, "")
    row, flat = row.filter(real), flat.filter(real).dictionary_encode()
    langs, sources = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    of_row = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    by_row = pa.table({"row": row, "term": flat.indices}).group_by(["row", "term"], use_threads=False)
    by_row = by_row.aggregate([([], "count_all")])
    group = of_row[by_row["row"].to_numpy()]
    by_group = pa.table({"group": group, "term": by_row["term"], "n": by_row["count_all"]})
    by_group = by_group.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    marks = np.unique(of_row)
    group = np.concatenate([by_group["group"].to_numpy(), marks])
    nothing = pa.array(np.zeros(len(marks), dtype=np.int64))
    return pa.table(
        {
            "lang": langs.dictionary.take(pa.array(group // len(sources.dictionary))),
            "source": sources.dictionary.take(pa.array(group % len(sources.dictionary))),
            "term": pa.chunked_array(
                [flat.dictionary.take(by_group["term"].combine_chunks()), pa.array([""] * len(marks))]
            ),
            "n": pa.chunked_array([*by_group["n_sum"].chunks, nothing]),
            "docs": pa.chunked_array([*by_group["n_count"].chunks, nothing]),
        }
    )


def _merged(tables: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False)
    added = added.aggregate([("n", "sum"), ("docs", "sum")])
    return added.rename_columns(["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` and ``docs`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows in _slices(batch):
                held.append(count_terms(rows))
                size += held[-1].num_rows
                if size > HELD:
                    held = [_merged(held)]
                    size = held[0].num_rows
                if size > HELD // 2 and len(held) == 1:
                    yield from held[0].combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from _merged(held).combine_chunks().to_batches()

    own = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    partial = own.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return materialize(counts, "counts")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * count / total)`` without a product beyond 64 bits, for ``count <= total < 9e15``."""
    quotient, rest = np.zeros_like(count), count
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + step
    return quotient + 1


def _highest(value: np.ndarray, place: np.ndarray, top: int) -> np.ndarray:
    """Indices of the ``top`` highest values, ties by ``place``."""
    if len(value) > top:
        least = np.partition(value, len(value) - top)[len(value) - top]
        chosen = np.flatnonzero(value >= least)
    else:
        chosen = np.arange(len(value))
    return chosen[np.lexsort((place[chosen], -value[chosen]))][:top]


def compare_shard(counts: pa.Table, groups: pa.Table, top: int = TOP) -> pa.Table:
    """``source``, ``part``, ``item``, ``value`` of one shard of a language's kept terms; each pair of sources once."""
    groups = groups.sort_by("source")
    sources = groups["source"].combine_chunks()
    total = groups["total"].to_numpy() + SMOOTH * groups["kept"].to_numpy()
    terms = counts["term"].combine_chunks().dictionary_encode()
    table = np.zeros((len(sources), len(terms.dictionary)), dtype=np.int64)
    table[pc.index_in(counts["source"], sources).to_numpy(), terms.indices.to_numpy()] = counts["n"].to_numpy()
    names, items, parts, values = [], [], [], []
    if table.shape[1]:
        shares = share(table + SMOOTH, total[:, None])
        whole = SMOOTH * groups["kept"][0].as_py() + groups["total"].to_numpy().sum()
        of_lang = share(table.sum(axis=0) + SMOOTH, whole)
        # Arrow orders strings by their bytes.
        place = np.empty(len(terms.dictionary), dtype=np.int64)
        place[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(place))
    for at in range(len(sources)):
        if table.shape[1]:
            apart = np.abs(shares[at + 1 :] - shares[at]).sum(axis=1)
            more = np.flatnonzero((table[at] > 0) & (shares[at] > of_lang))
            more = more[_highest((shares[at] - of_lang)[more], place[more], top)]
        else:
            apart, more = np.zeros(len(sources) - at - 1, dtype=np.int64), np.empty(0, dtype=np.int64)
        for part, item, value in (
            ("pair", sources[at + 1 :], apart),
            ("term", terms.dictionary.take(pa.array(more)), (shares[at] - of_lang)[more] if len(more) else more),
        ):
            names.append(pa.repeat(sources[at], len(item)))
            parts.append(pa.repeat(pa.scalar(part), len(item)))
            items.append(item.cast("string"))
            values.append(pa.array(value, pa.int64()))
    columns = {"source": names, "part": parts, "item": items, "value": values}
    return pa.table({name: pa.chunked_array(chunks) for name, chunks in columns.items()})


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of all groups."""
    counts = term_counts(docs)
    terms = counts.filter("term <> ''")
    vocabulary = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    vocabulary = materialize(vocabulary.drop("docs"), "vocabulary")
    kept = materialize(
        terms.join(vocabulary, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept"
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = (
        counts.filter("term = ''")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .na.fill(0, ["total", "kept"])
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    )
    pairs = F.col("sources") * F.col("sources")
    cells = F.least(F.greatest(pairs, F.lit(LEAST_CELLS)), F.lit(CELLS))
    shards = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / cells))
    groups = materialize(groups.withColumn("shards", shards.cast("long")), "groups")
    discard(counts, vocabulary)
    dealt = kept.join(groups.select("lang", "shards").distinct(), "lang")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("term"), "shards")).drop("shards")
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))

    def compare(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        found = compare_shard(counts, groups, top)
        return found.add_column(0, "lang", pa.repeat(key[0], found.num_rows))

    found = dealt.groupBy("lang", "shard").cogroup(everywhere.groupBy("lang", "shard"))
    found = found.applyInArrow(compare, "lang string, source string, part string, item string, value long")
    found = materialize(found, "shards")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("pair"), "part", "value")
    pairs = pairs.select("lang", "pair.source", "part", "pair.item", "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    own = found.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(own.filter(F.col("rank") <= top))
