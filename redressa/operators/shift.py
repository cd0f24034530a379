"""Change of expression around the cutoff: shares, indices, matched neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.session import materialize

# Hits per word, so that a long text does not score high by its length.
DENSITIES = {
    "legal_density": "legal_term_count",
    "evidence_density": "evidence_term_count",
    "template_density": "template_phrase_count",
    "connective_density": "connective_count",
}
# Dimension of the index -> the measures that make it up.
INDEX_GROUPS = {
    "legal": ("legal_density",),
    "evidence": ("evidence_density",),
    "structure": ("avg_sentence_len", "connective_density", "n_paragraphs"),
    "template": ("template_density",),
}
INDEX_DIMENSIONS = tuple(m for group in INDEX_GROUPS.values() for m in group)
SHIFT_MEASURES = {
    "words": "n_words",
    "legal_terms": "legal_term_count",
    "template_phrases": "template_phrase_count",
    "any_relief": "any_relief",
}
MATCH_KEYS = ("issue", "company", "state", "month_of_year")
_SALTS = 64


def yearly_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("complaint_year").isNotNull())
        .groupBy("complaint_year")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("complaint_year")
    )


def _sides(flag: str) -> tuple[Column, Column]:
    return F.col(flag) == 0, F.col(flag) == 1


def period_share(
    df: DataFrame, flag: str = "post_cutoff", outcome: str = "any_relief"
) -> DataFrame:
    """One row: size and share of both periods, outcome rates and their difference in points."""
    before, after = _sides(flag)
    y = F.col(outcome).cast("double")
    return df.agg(
        F.count_if(before).alias("n_before"),
        F.count_if(after).alias("n_after"),
        F.avg(F.when(before, y)).alias("rate_before"),
        F.avg(F.when(after, y)).alias("rate_after"),
    ).select(
        "n_before",
        "n_after",
        F.try_divide(F.col("n_before").cast("double"), F.col("n_before") + F.col("n_after")).alias(
            "share_before"
        ),
        F.try_divide(F.col("n_after").cast("double"), F.col("n_before") + F.col("n_after")).alias(
            "share_after"
        ),
        "rate_before",
        "rate_after",
        ((F.col("rate_after") - F.col("rate_before")) * 100.0).alias("points"),
    )


def group_shift(
    df: DataFrame,
    by: str = "product_group",
    flag: str = "post_cutoff",
    measures: Mapping[str, str] = SHIFT_MEASURES,
) -> DataFrame:
    """Per group: rows in both periods and the after-minus-before mean differences."""
    before, after = _sides(flag)
    shifts = []
    for name, source in measures.items():
        x = F.col(source).cast("double")
        shifts.append(
            (F.avg(F.when(after, x)) - F.avg(F.when(before, x))).alias(f"{name}_shift")
        )
    return (
        df.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"), *shifts
        )
    )


def share_shift(df: DataFrame, topic: str, flag: str = "post_cutoff") -> DataFrame:
    """Per topic: its share of each period and the change in points."""
    before, after = _sides(flag)
    counts = (
        df.filter(F.col(topic).isNotNull())
        .groupBy(topic)
        .agg(F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"))
    )
    totals = counts.agg(
        F.struct(F.sum("n_before").alias("before"), F.sum("n_after").alias("after"))
    ).scalar()
    share_before = F.try_divide(F.col("n_before").cast("double"), totals["before"])
    share_after = F.try_divide(F.col("n_after").cast("double"), totals["after"])
    return counts.select(
        topic,
        "n_before",
        "n_after",
        share_before.alias("share_before"),
        share_after.alias("share_after"),
        ((share_after - share_before) * 100.0).alias("points"),
    )


def cross_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per pair of values, with the share within ``a`` (long form of a heat map)."""
    counts = (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(a, b)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    within = F.sum("n").over(Window.partitionBy(a))
    return counts.withColumn("share", F.col("n") / within)


def _with_standardized(df: DataFrame, dims: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with the moments of ``dims`` in ``_moments``, and the z-scores on it.

    A constant dimension has the score 0.
    """
    moments = df.agg(
        F.struct(
            *[F.avg(F.col(d).cast("double")).alias(f"{d}_mean") for d in dims],
            *[F.stddev_pop(F.col(d).cast("double")).alias(f"{d}_sd") for d in dims],
        )
    )
    m = F.col("_moments")
    scores = [
        F.when(
            m[f"{d}_sd"] > 0, (F.col(d).cast("double") - m[f"{d}_mean"]) / m[f"{d}_sd"]
        ).otherwise(F.lit(0.0))
        for d in dims
    ]
    return df.withColumn("_moments", moments.scalar()), scores


def with_densities(df: DataFrame) -> DataFrame:
    """Append the hits per word of the index; a text without words has none."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({d: F.col(c).cast("double") / words for d, c in DENSITIES.items()})


def expression_index(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]] = INDEX_GROUPS,
    output: str = "expression_index",
) -> DataFrame:
    """Append the mean over the dimensions, each the mean of its standardized measures.

    A constant measure adds 0.
    """
    dims = [m for group in groups.values() for m in group]
    missing = [d for d in dims if d in DENSITIES and d not in df.columns]
    measured, scores = _with_standardized(with_densities(df) if missing else df, dims)
    score = dict(zip(dims, scores, strict=True))
    means = [sum((score[m] for m in group), F.lit(0.0)) / len(group) for group in groups.values()]
    index = measured.withColumn(output, sum(means, F.lit(0.0)) / len(groups))
    return index.drop("_moments", *missing)


def pca_index(
    df: DataFrame, key: str, dims: Sequence[str] = INDEX_DIMENSIONS
) -> tuple[DataFrame, list[float]]:
    """The index with first-principal-component weights, and those weights.

    The sign is set so that the weights add up to a positive number.
    """
    measured, scores = _with_standardized(df, dims)
    standard = measured.select(key, *[s.alias(d) for s, d in zip(scores, dims, strict=True)])
    rows = VectorAssembler(inputCols=list(dims), outputCol="_dims").transform(standard)
    model = PCA(k=1, inputCol="_dims", outputCol="_score").fit(rows)
    weights = model.pc.toArray()[:, 0]
    sign = 1.0 if weights.sum() >= 0 else -1.0
    scored = model.transform(rows).select(
        key, (vector_to_array("_score")[0] * sign).alias("pca_index")
    )
    return scored, [float(w * sign) for w in weights]


def _piece(key: str) -> Column:
    """A match value in a form that stays unambiguous when pieces are joined."""
    value = F.col(key).cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def _digest(pieces: Sequence[Column]) -> Column:
    """Sixteen bytes that name a combination of values: short keys sort and shuffle fast."""
    return F.unhex(F.md5(F.concat_ws("|", *pieces)))


def _cell(block: str, keys: Sequence[str]) -> Column:
    """Name of a combination of all match values, nulls included."""
    return _digest([_piece(k) for k in (block, *keys)])


def _with_patterns(df: DataFrame, block: str, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """``kept`` columns, once per subset of the match keys that has no null in it.

    ``_group`` names the subset together with the block and the values in it;
    ``_bits`` is the size of the subset.
    """
    patterns = []
    for mask in range(1 << len(keys)):
        inside = [k for i, k in enumerate(keys) if mask >> i & 1]
        known = F.lit(True)
        for key in inside:
            known = known & F.col(key).isNotNull()
        pieces = [F.lit(str(mask)), _piece(block), *[_piece(k) for k in inside]]
        patterns.append(
            F.when(
                known,
                F.struct(_digest(pieces).alias("_group"), F.lit(len(inside)).alias("_bits")),
            )
        )
    return (
        df.filter(F.col(block).isNotNull())
        .select(*kept, F.explode(F.filter(F.array(*patterns), lambda p: p.isNotNull())).alias("_p"))
        .select(*kept, "_p._group", "_p._bits")
    )


def _first_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """First k rows per group. Spark trims each map task to k before shuffling."""
    ranked = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def cell_neighbours(
    df: DataFrame,
    block: str,
    keys: Sequence[str],
    k: int,
    flag: str = "post_cutoff",
    key: str = "complaint_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """The k nearest earlier rows for each combination of match values after the cutoff.

    Candidates share the block; nearer means more equal match keys, then the
    smaller id. Rows after the cutoff with the same values share one answer,
    so combinations ('cells') are matched, not rows. For every subset of the
    keys only the first k earlier rows per value combination can be among the
    k nearest: a later one has k rows before it that match at least as well.
    Hence 2^keys lookups of at most k rows each give the exact answer, and no
    pair of rows is formed within a block. The ``carry`` columns of a neighbour
    come along, so that no join back to a much-used neighbour is needed.

    Columns ``_cell``, neighbour_id, matches, the carried ones, and rank.
    """
    flagged = F.col(flag)
    earlier = df.filter(flagged == 0).withColumnRenamed(key, "neighbour_id")
    near = ["neighbour_id", *carry]
    per_cell = _first_k(earlier, [block, *keys], ["neighbour_id"], k)
    index = (
        _first_k(
            _with_patterns(per_cell, block, keys, near), ["_group", "_bits"], ["neighbour_id"], k
        )
        .groupBy("_group", "_bits")
        .agg(F.collect_list(F.struct(*near)).alias("_near"))
    )
    cells = df.filter(flagged == 1).select(block, *keys).distinct()
    wanted = _with_patterns(cells.withColumn("_cell", _cell(block, keys)), block, keys, ["_cell"])
    # Small subsets are looked up by many cells: spread those lookups.
    salts = F.greatest(F.lit(1), F.lit(_SALTS) / F.pow(F.lit(4), F.col("_bits"))).cast("int")
    index = index.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    wanted = wanted.select(
        "_cell", "_group", F.pmod(F.xxhash64("_cell"), salts).cast("int").alias("_salt")
    )
    found = (
        wanted.join(index, ["_group", "_salt"])
        .repartition("_cell")  # serves the grouping and the ranking
        .select("_cell", "_bits", F.inline("_near"))
        .groupBy("_cell", "neighbour_id")
        .agg(F.max("_bits").alias("matches"), *[F.first(c).alias(c) for c in carry])
    )
    return _first_k(found, ["_cell"], [F.desc("matches"), F.asc("neighbour_id")], k)


def with_month_of_year(df: DataFrame) -> DataFrame:
    return df.withColumn("month_of_year", F.month("date_received"))


def matched_neighbours(
    df: DataFrame,
    block: str = "product_group",
    keys: Sequence[str] = MATCH_KEYS,
    k: int = 5,
    flag: str = "post_cutoff",
    key: str = "complaint_id",
) -> DataFrame:
    """key, neighbour_id, matches, rank: the k nearest earlier complaints.

    The match columns are written once, as they are read three times. The answers per
    cell are written too: both sides of the last join are then plain exchanges, which
    can be split at run time where one cell holds many of the rows.
    """
    df = materialize(df.select(key, block, *keys, flag), "match-values")
    nearest = materialize(cell_neighbours(df, block, keys, k, flag, key), "nearest")
    targets = df.filter(F.col(flag) == 1).select(key, _cell(block, keys).alias("_cell"))
    return targets.join(nearest, "_cell").select(key, "neighbour_id", "matches", "rank")


def local_shift(
    df: DataFrame,
    value: str = "expression_index",
    block: str = "product_group",
    keys: Sequence[str] = MATCH_KEYS,
    k: int = 5,
    flag: str = "post_cutoff",
    key: str = "complaint_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows after the cutoff with their value minus the mean of their neighbours'.

    Columns key, the value, the kept ones, neighbours, neighbour_mean, local_shift. A
    row without any neighbour has 0 of them and no shift. The neighbours' mean is taken
    once per cell and written, then joined to the rows by plain exchanges, which can be
    split at run time where one cell holds many of the rows.
    """
    columns = dict.fromkeys([key, block, *keys, flag, value, *keep])
    df = materialize(df.select(*columns), "match-values")
    means = (
        cell_neighbours(df, block, keys, k, flag, key, carry=[value])
        .groupBy("_cell")
        .agg(F.avg(value).alias("neighbour_mean"), F.count(F.lit(1)).alias("neighbours"))
    )
    return (
        df.filter(F.col(flag) == 1)
        .select(key, value, *keep, _cell(block, keys).alias("_cell"))
        .join(materialize(means, "means"), "_cell", "left")
        .withColumn("neighbours", F.coalesce("neighbours", F.lit(0).cast("long")))
        .withColumn("local_shift", F.col(value) - F.col("neighbour_mean"))
        .drop("_cell")
    )


def event_study(
    df: DataFrame, cutoff: str, value: str = "expression_index", date: str = "date_received"
) -> DataFrame:
    """Mean value by calendar month, counted from the month of the cutoff."""
    start = F.lit(cutoff).cast("date")
    offset = (F.year(date) - F.year(start)) * 12 + F.month(date) - F.month(start)
    return (
        df.filter(F.col(date).isNotNull())
        .groupBy(offset.cast("int").alias("month_offset"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
        .orderBy("month_offset")
    )


def embedding_clusters(
    df: DataFrame, key: str, vector: str, k: int = 8, seed: int = 42, max_iter: int = 20
) -> DataFrame:
    """Cluster number of each row from k-means on a given array column."""
    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_vector"))
    model = KMeans(
        k=k, seed=seed, maxIter=max_iter, featuresCol="_vector", predictionCol="cluster"
    ).fit(rows)
    return model.transform(rows).select(key, "cluster")
