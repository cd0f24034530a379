"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document when at least ``CONTAINMENT_PERCENT`` percent of the item's distinct
five-word shingles are in the document, however long that is. Resemblance sketches miss
a short item in a long text, so the search is on containment: items are put into classes
by their number of shingles (powers of two), and an item is sketched by the smallest
shingle hashes (MinHash order), as many as its class needs: an item of n shingles, of
which ``n - ceil(0.8 n)`` may be missing, has a sketch one longer than that at the
class's upper size. A document that contains the item must then hold at least one
sketched shingle, so the search loses nothing, and a document with too few shingles for a
class's smallest item is no candidate. Candidates are verified exactly: shingles of the
candidate documents are compared as text with all shingles of the items.

Words are runs of letters and digits in lower case, so case, punctuation and line breaks
do not hide an item. An item of under five words is one shingle of all its words, and
documents are read with that length too.

Scale: documents are one scan, hashed in place; only shingles whose hash is in a sketch
leave it. Item hashes are broadcast when the items have at most ``BROADCAST_ROWS`` shingles,
which are counted, else the joins are ordinary shuffled ones. Shingles of candidates only are shuffled, and sums by
(document, item) combine on the map side.

Defined results: null, empty and wordless texts and items contain and match nothing.
A repeated item_id with one text is one item; with other texts, each text counts and the
best containment is given. A null item_id or doc_id is a value like others. Rows with equal
doc_id and text share the verdict; rows with one doc_id and other texts are searched apart
and the best containment is given. Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.session import materialize

SHINGLE = 5
CONTAINMENT_PERCENT = 80
BROADCAST_ROWS = 500_000


def _needed(n: Column) -> Column:
    """Shingles of an item of ``n`` that a document must hold."""
    return F.ceil(F.lit(CONTAINMENT_PERCENT) * n / 100).cast("long")


def _words(text: Column) -> Column:
    plain = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


def _zipped(words: Column, size: int) -> Column:
    """Windows of ``size`` words as structs; the last ``size - 1`` end in nulls."""
    return F.arrays_zip(
        *[
            (words if k == 0 else F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0)))).alias(f"w{k}")
            for k in range(size)
        ]
    )


def _shingles(df: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``keep`` and the words ``w0 ..`` of every shingle of ``size`` words."""
    narrow = df.select(*keep, F.explode(_zipped(F.col("words"), size)).alias("w"))
    return narrow.filter(F.col(f"w.w{size - 1}").isNotNull()).select(*keep, "w.*")


def _hash(size: int) -> Column:
    return F.xxhash64(*[F.col(f"w{k}") for k in range(size)])


def _joined(size: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"w{k}") for k in range(size)])


def item_shingles(items: DataFrame) -> DataFrame:
    """Distinct shingles: ``item`` (number of its text), ``item_id``, ``size``, ``hash``,
    ``shingle``, ``n`` (how many the item has) and ``sketch`` (is it in the sketch)."""
    words = items.select("item_id", _words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    words = words.distinct().withColumn("item", F.xxhash64(F.array_join("words", " ")))
    parts = None
    for size in range(1, SHINGLE + 1):
        enough = F.size("words") >= SHINGLE if size == SHINGLE else F.size("words") == size
        some = _shingles(words.filter(enough), ["item", "item_id"], size).select(
            "item", "item_id", F.lit(size).alias("size"), _hash(size).alias("hash"), _joined(size).alias("shingle")
        )
        parts = some if parts is None else parts.union(some)
    own = Window.partitionBy("item", "item_id")
    counted = parts.distinct().withColumn("n", F.count("*").over(own))
    order = F.row_number().over(own.orderBy("hash", "shingle"))
    least, most = _class_bounds(F.col("n"))
    allowed = most - _needed(most)
    return counted.withColumn("sketch", order <= allowed + 1).withColumn(
        "least", _needed(least)
    )


def _class_bounds(n: Column) -> tuple[Column, Column]:
    """Sizes of the class of n: a power of two and one less than the next."""
    power = F.floor(F.log2(n.cast("double")) + F.lit(1e-12)).cast("int")
    least = F.pow(F.lit(2.0), power).cast("long")
    return least, 2 * least - 1


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shingles``, ``n_shared``, ``containment`` of each find."""
    shingles = materialize(item_shingles(items), "items")
    counts = {r["size"]: r["n"] for r in shingles.groupBy("size").agg(F.count("*").alias("n")).collect()}
    worded = docs.select("doc_id", _words(F.col("text")).alias("words"))
    named = worded.withColumn("doc", F.xxhash64("words"))
    found = None
    for size, n in sorted(counts.items()):
        own = shingles.filter(F.col("size") == size)
        sketch = own.filter("sketch").select("hash", "least").groupBy("hash").agg(F.min("least").alias("least"))
        sketch = F.broadcast(sketch) if n <= BROADCAST_ROWS else sketch
        # What a document has at most: one shingle for each word but the last ones.
        most = F.size("words") - (size - 1)
        candidates = materialize(
            _shingles(named.withColumn("most", most), ["doc_id", "doc", "most"], size)
            .select("doc_id", "doc", "most", _hash(size).alias("hash"))
            .join(sketch, "hash")
            .filter(F.col("most") >= F.col("least"))
            .select("doc_id", "doc")
            .distinct(),
            "candidates",
        )
        texts = named.join(
            candidates.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc")),
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc")),
            "left_semi",
        )
        wanted = own.select("item", "item_id", "shingle", "n", "hash")
        hashes = own.select("hash").distinct()
        few = _shingles(texts, ["doc_id", "doc"], size).withColumn("hash", _hash(size))
        few = few.join(F.broadcast(hashes) if n <= BROADCAST_ROWS else hashes, "hash", "left_semi")
        shared = (
            few.select("doc_id", "doc", _joined(size).alias("shingle"))
            .distinct()
            .join(wanted, "shingle")
            .groupBy("doc_id", "doc", "item_id", "item", "n")
            .agg(F.count("*").alias("n_shared"))
            .filter(F.col("n_shared") >= _needed(F.col("n")))
        )
        found = shared if found is None else found.union(shared)
    if found is None:
        found = worded.join(shingles, F.lit(False)).select(
            "doc_id", F.lit(0).alias("doc"), "item_id", "item", "n", F.lit(0).cast("long").alias("n_shared")
        )
    best = F.max_by(F.struct("n", "n_shared"), F.struct(F.col("n_shared") / F.col("n"), F.col("n"), F.col("n_shared")))
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best.alias("best"))
        .select(
            "doc_id",
            "item_id",
            F.col("best.n").alias("n_shingles"),
            F.col("best.n_shared").alias("n_shared"),
            F.round(F.col("best.n_shared") / F.col("best.n"), 6).alias("containment"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id holds no item, with their own columns."""
    hit = find_items(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]), "left_anti")
