"""Group effects of many levels taken out of numbers, by alternating projections.

Subtracting the group means of one variable after another, again and again, ends at the residuals of a regression on all levels of all
variables, without a column per level. Means depend on sums only, so the rounds run on cells (rows alike in all variables, with their
number and means), which are written after each round; the rows meet the result once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.session import discard, materialize

MISSING = "Missing"


def _without_means(cells: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    means = cells.groupBy(group).agg(
        *[(F.sum(F.col(c) * F.col("_n")) / F.sum("_n")).alias(f"_mean_{i}") for i, c in enumerate(columns)]
    )
    names = {c: F.col(c) - F.col(f"_mean_{i}") for i, c in enumerate(columns)}
    return cells.join(means, group).withColumns(names).select(*cells.columns)


def group_means(df: DataFrame, columns: Sequence[str], groups: Sequence[str], weight: str | None = None) -> DataFrame:
    """variable, level, n and the means of ``columns``, over the levels of each of ``groups``."""
    w = F.col(weight) if weight else F.lit(1)
    levels = F.array(*[F.struct(F.lit(g).alias("variable"), F.col(g).alias("level")) for g in groups])
    sums = [(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in columns]
    kept = [*columns, weight] if weight else columns
    return df.select(*kept, F.inline(levels)).groupBy("variable", "level").agg(F.sum(w).alias("n"), *sums)


def absorb(
    df: DataFrame, columns: Sequence[str], groups: Sequence[str], tol: float = 1e-7, rounds: int = 100
) -> DataFrame:
    """``df`` with ``columns`` less the effects of all levels of ``groups``.

    Null levels are a level of their own, also in the result. Rounds end when no level has a mean beyond ``tol`` of the column's standard
    deviation. A row with a null number has no part in the means and stays null.
    """
    named = df.withColumns({g: F.coalesce(F.col(g).cast("string"), F.lit(MISSING)) for g in groups})
    whole = named.dropna(subset=list(columns))
    cells = whole.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in columns]
    )
    scales = whole.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    first = materialize(cells, "cells")
    cells = first
    for _ in range(rounds):
        after = cells
        for group in groups:
            after = _without_means(after, group, columns)
        after = materialize(after, "cells")
        if cells is not first:
            discard(cells)
        cells = after
        worst = group_means(cells, columns, groups, "_n").agg(*[F.max(F.abs(c)).alias(c) for c in columns]).first()
        if all((worst[c] or 0.0) <= tol * (scales[c] or 0.0) + 1e-300 for c in columns):
            break
    effects = first.join(
        cells.select(*groups, *[F.col(c).alias(f"_left_{i}") for i, c in enumerate(columns)]), list(groups)
    ).select(*groups, *[(F.col(c) - F.col(f"_left_{i}")).alias(f"_effect_{i}") for i, c in enumerate(columns)])
    found = materialize(effects, "effects")
    discard(cells)
    joined = named.join(found, list(groups), "left")
    less = {c: F.col(c) - F.col(f"_effect_{i}") for i, c in enumerate(columns)}
    return joined.withColumns(less).select(*df.columns)
