"""Response models: logistic baseline, boosted trees, attribution, effects."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.operators import logistic, metrics, trees
from redressa.operators.blocks import Block, sparse_blocks, summed
from redressa.operators.encoding import CATEGORICAL_FEATURES, Encoder, fill_inputs
from redressa.operators.folds import fold_encoders
from redressa.operators.logistic import Logistic
from redressa.operators.profile import NUMERIC_FEATURES
from redressa.operators.splitting import balanced_weights, class_gate, cv_folds, stratified_split
from redressa.operators.trees import Boosted
from redressa.operators.vectors import Vocabulary, fit_vocabulary, narrative_words, vector_entries, with_terms
from redressa.session import discard, materialize


INTERCEPT = "(intercept)"


def with_class_weights(train: DataFrame, target: str) -> DataFrame:
    """Append ``weight``, so that both classes weigh the same in total."""
    weights = F.broadcast(balanced_weights(train, target).select("class", "weight"))
    return train.join(weights, F.col(target).cast("int") == F.col("class")).drop("class")


def fit_logistic(
    train: DataFrame, target: str = "label", features: str = "features", c: float = 1.0, **options
) -> Logistic:
    """L2 logistic regression with balanced class weights.

    ``c`` weighs the summed loss against half the squared coefficients, the intercept among them.
    """
    return logistic.fit(with_class_weights(train, target), target, features=features, c=c, **options)


def top_features(
    names: Sequence[str], coefficients: Sequence[float], like: DataFrame, n: int = 40
) -> DataFrame:
    """The n highest and the n lowest coefficients."""
    table = like.sparkSession.createDataFrame(
        [(name, float(c)) for name, c in zip(names, coefficients, strict=True)],
        "feature string, coef double",
    ).withColumn("abs_coef", F.abs("coef"))
    high = table.orderBy(F.desc("coef"), "feature").limit(n)
    low = table.orderBy(F.asc("coef"), "feature").limit(n)
    return high.withColumn("direction", F.lit("positive")).unionByName(
        low.withColumn("direction", F.lit("negative"))
    )


@dataclass(frozen=True)
class ResponseModel:
    """A fitted logistic response model and what it was measured on."""

    target: str
    names: list[str]
    model: Logistic
    train: DataFrame
    test: DataFrame
    scored: DataFrame

    def metrics(self) -> DataFrame:
        """One row: sizes, threshold metrics at 0.5, ROC AUC, average precision."""
        sizes = self.train.agg(
            F.count(F.lit(1)).alias("n_train"),
            F.avg(F.col("label").cast("double")).alias("positive_rate_train"),
        )
        sized = sizes.select(F.struct("*")).scalar()
        ranked = metrics.rank_metrics(self.scored).select(F.struct("*")).scalar()
        return metrics.binary_metrics(self.scored).select(
            F.lit(self.target).alias("target"),
            F.lit("fit").alias("status"),
            sized["n_train"].alias("n_train"),
            F.col("n_rows").alias("n_test"),
            sized["positive_rate_train"].alias("positive_rate_train"),
            F.col("positive_rate").alias("positive_rate_test"),
            "accuracy",
            "balanced_accuracy",
            "f1",
            ranked["roc_auc"].alias("roc_auc"),
            ranked["average_precision"].alias("average_precision"),
        )

    def class_report(self) -> DataFrame:
        return metrics.class_report(self.scored)

    def top_features(self, n: int = 40) -> DataFrame:
        return top_features(self.names, self.model.coefficients, self.test, n)

    def gradient(self) -> DataFrame:
        """feature, and the slope of the loss at its coefficient, summed over the train rows' scores.

        It says how far the fit is from the optimum, without a step of the fit itself.
        """
        coefficients, intercept, size = self.model.coefficients, self.model.intercept, len(self.names) + 1
        weighed = with_class_weights(self.train, "label").select("features", "label", "weight")
        blocks = sparse_blocks(weighed, "features", ("label", "weight"), "gradient")

        def slopes_of(block: Block) -> np.ndarray:
            score = 1 / (1 + np.exp(-(block.dot(coefficients) + intercept)))
            off = block.given["weight"] * (score - block.given["label"])
            # The intercept is the coefficient of a constant 1 at the end.
            return np.append(block.dot_rows(off, size - 1), off.sum())

        slopes = summed(blocks, slopes_of, size)
        discard(blocks)
        gradient = slopes + np.append(coefficients, intercept)
        return self.train.sparkSession.createDataFrame(
            [(n, float(g)) for n, g in zip([*self.names, INTERCEPT], gradient, strict=True)], "feature string, gradient double"
        )


def write_inputs(
    df: DataFrame,
    target: str,
    key: str = "complaint_id",
    text: str | None = "consumer_narrative",
    categories: Sequence[str] = CATEGORICAL_FEATURES,
    numbers: Sequence[str] = NUMERIC_FEATURES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The rows with a target, written: key, ``label``, filled inputs, ``kept_words`` of the text, and ``keep``."""
    usable = fill_inputs(df.filter(F.col(target).isNotNull()), categories, numbers)
    columns = [key, F.col(target).cast("int").alias("label"), *categories, *numbers, *keep]
    if text:
        usable = narrative_words(usable, text, batched=True)
        columns.append("kept_words")
    return materialize(usable.select(*columns), f"inputs-{target}")


def prepare_split(
    base: DataFrame,
    key: str = "complaint_id",
    categories: Sequence[str] = CATEGORICAL_FEATURES,
    numbers: Sequence[str] = NUMERIC_FEATURES,
    size: int = 6000,
    min_df: int = 5,
    max_df: float = 0.9,
    seed: int = 42,
    split: Callable[[DataFrame], DataFrame] | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[Encoder, DataFrame, DataFrame]:
    """Split the rows of :func:`write_inputs`, fit the encoder on train rows only, and encode both parts.

    The labelled split is written once: vocabulary, levels, scales and encoding all read it.
    The returned train and test frames read a written table too. ``split`` makes the parts; by default it
    is the stratified one. ``derive`` may add columns to the split rows, from what it fits on those with ``part`` 'train';
    ``categories`` and ``numbers`` may name them. ``base`` is used up.
    """
    parted = split(base) if split else stratified_split(base, "label", key, seed=seed)
    labelled = materialize(parted.filter("part IS NOT NULL"), "split")
    discard(base)
    if derive:
        before, labelled = labelled, materialize(derive(labelled), "derived")
        discard(before)
    train = labelled.filter("part = 'train'")
    vocabulary, words = None, "kept_words" if "kept_words" in base.columns else None
    if words:
        vocabulary = Vocabulary.of(fit_vocabulary(with_terms(train), "terms", min_df, max_df, size, words))
    encoder = Encoder.fit(train, vocabulary, categories, numbers)
    encoded = encoder.transform(labelled, words=words).select(key, "label", "part", "features")
    written = materialize(encoded, "encoded")
    discard(labelled)
    return encoder, written.filter("part = 'train'"), written.filter("part = 'test'")


def fit_response_model(
    df: DataFrame,
    target: str,
    key: str = "complaint_id",
    min_class: int = 30,
    **options,
) -> ResponseModel | dict:
    """The logistic response model, or the class gate's record if it was skipped."""
    columns = {n: options.pop(n) for n in ("text", "categories", "numbers") if n in options}
    base = write_inputs(df, target, key, **columns)
    gate = class_gate(base.withColumnRenamed("label", target), target, min_class)
    if gate["status"] == "skipped":
        discard(base)
        return gate
    columns.pop("text", None)
    encoder, train, test = prepare_split(base, key, **columns, **options)
    model = fit_logistic(train)
    scored = materialize(model.score(test, key), f"scored-{target}")
    return ResponseModel(target, encoder.names, model, train, test, scored)


def cross_validate(
    base: DataFrame,
    key: str,
    penalties: Sequence[float],
    k: int = 5,
    seed: int = 42,
    categories: Sequence[str] = CATEGORICAL_FEATURES,
    numbers: Sequence[str] = NUMERIC_FEATURES,
    **vocabulary,
) -> DataFrame:
    """Area under the ROC curve per L2 penalty and hashed fold: penalty, fold, n_features, roc_auc.

    ``base`` are rows of :func:`write_inputs`. Vocabulary, levels, scales and weights of a fold come from the other
    folds only. A penalty is that of the mean loss, as a share of half the squared coefficients.
    """
    text = "kept_words" in base.columns
    folded = cv_folds(base, key, k, seed)
    folded = with_terms(folded) if text else folded
    found = []
    for fold, encoder in enumerate(fold_encoders(folded, k, categories, numbers, text, **vocabulary)):
        encoded = encoder.transform(folded, words="kept_words" if text else None)
        encoded = materialize(encoded.select(key, "label", "fold", "features"), "fold")
        train, own = encoded.filter(F.col("fold") != fold), encoded.filter(F.col("fold") == fold)
        n = train.count()
        for penalty in penalties:
            model = fit_logistic(train, c=1.0 / (penalty * n))
            area = metrics.roc_auc(model.score(own, key)).first()["roc_auc"]
            found.append((float(penalty), fold, len(encoder.names), area))
        discard(encoded)
    return base.sparkSession.createDataFrame(found, "penalty double, fold int, n_features int, roc_auc double")


def fit_gbt(train: DataFrame, **options) -> Boosted:
    """Gradient-boosted trees on the encoded rows, balanced by class weight."""
    return trees.fit(with_class_weights(train, "label"), **options)


def linear_attribution(
    df: DataFrame, features: str, names: Sequence[str], coefficients: Sequence[float]
) -> DataFrame:
    """Mean absolute contribution coef * (x - mean) of each feature.

    Only non-zero entries are unfolded; the rows where a feature is zero all
    contribute |coef * mean|, so their number is enough.
    """
    spark = df.sparkSession
    indices, values = vector_entries(F.col(features))
    entries = df.select(
        F.explode(F.arrays_zip(indices.alias("feature_id"), values.alias("x"))).alias("e")
    ).select("e.feature_id", "e.x")
    n = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    means = entries.groupBy("feature_id").agg(
        (F.sum("x") / n).alias("mean"), F.count(F.lit(1)).alias("filled")
    )
    table = spark.createDataFrame(
        [(i, m, float(c)) for i, (m, c) in enumerate(zip(names, coefficients, strict=True))],
        "feature_id int, feature string, coef double",
    )
    # One row per feature, and their number is fixed by the fitted encoder.
    spread_of = (
        entries.join(F.broadcast(means), "feature_id")
        .groupBy("feature_id")
        .agg(
            F.sum(F.abs(F.col("x") - F.col("mean"))).alias("moved"),
            F.first("mean").alias("mean"),
            F.first("filled").alias("filled"),
        )
    )
    moved = F.col("moved") + (n - F.col("filled")) * F.abs("mean")
    return (
        table.join(spread_of, "feature_id", "left")
        .select(
            "feature",
            "coef",
            F.coalesce(F.abs("coef") * moved / n, F.lit(0.0)).alias("mean_abs_contribution"),
        )
    )


def partial_linear(
    df: DataFrame,
    outcome: str,
    treatment: str,
    controls: Sequence[str],
    key: str,
    folds: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Residuals of outcome and treatment after the controls, cross-fitted.

    Each fold's rows are predicted by regressions fitted on the other folds.
    Appends ``outcome_residual`` and ``treatment_residual``; their slope
    (:func:`residual_slope`) is the partially linear effect.
    """
    vector = VectorAssembler(inputCols=list(controls), outputCol="_controls")
    folded = vector.transform(cv_folds(df, key, folds, seed))
    written = materialize(folded, "folds")
    parts = []
    for fold in range(folds):
        rest, own = written.filter(F.col("fold") != fold), written.filter(F.col("fold") == fold)
        for column in (outcome, treatment):
            learner = LinearRegression(
                featuresCol="_controls",
                labelCol=column,
                predictionCol=f"_{column}_fit",
                solver="normal",
            )
            own = learner.fit(rest).transform(own)
        parts.append(own)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumns(
        {
            "outcome_residual": F.col(outcome) - F.col(f"_{outcome}_fit"),
            "treatment_residual": F.col(treatment) - F.col(f"_{treatment}_fit"),
        }
    ).drop("_controls", f"_{outcome}_fit", f"_{treatment}_fit")


def residual_slope(residuals: DataFrame) -> DataFrame:
    """Residual-on-residual slope with its robust standard error, one row."""
    y, t = F.col("outcome_residual"), F.col("treatment_residual")
    sums = residuals.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(t * y).alias("ty"),
        F.sum(t * t).alias("tt"),
        F.sum(t * t * y * y).alias("ttyy"),
        F.sum(t * t * t * y).alias("ttty"),
        F.sum(t * t * t * t).alias("tttt"),
    )
    slope = F.try_divide(F.col("ty"), F.col("tt"))
    # sum of (t * (y - slope * t))^2, expanded
    noise = F.col("ttyy") - slope * F.col("ttty") * 2 + slope * slope * F.col("tttt")
    return sums.select(
        "n",
        slope.alias("slope"),
        F.try_divide(F.sqrt(F.greatest(noise, F.lit(0.0))), F.col("tt")).alias("std_error"),
    )


def clustered_slopes(
    residuals: DataFrame, dimensions: Sequence[str], cluster: str, min_clusters: int = 5
) -> DataFrame:
    """Slope and cluster-robust error for each level of each dimension.

    Columns dimension, level, n, clusters, slope, std_error. Only sums by (level, cluster) are
    shuffled: a cluster's score sum((t - T)(y - Y - b(t - T))) is linear in its sums, so the
    squares' total over the clusters is made of the sums' products and needs neither the rows again nor
    a group in one task. The error is null below ``min_clusters`` clusters; a null cluster is
    one of them.
    """
    y, t = F.col("outcome_residual"), F.col("treatment_residual")
    levels = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])
    rows = residuals.select(F.col(cluster).alias("_cluster"), y.alias("y"), t.alias("t"), F.inline(levels))
    names = ("ty", "t", "y", "c", "tt")
    sums = (
        rows.filter("level IS NOT NULL")
        .groupBy("dimension", "level", "_cluster")
        .agg(
            F.sum(F.col("t") * F.col("y")).alias("ty"),
            F.sum("t").alias("t"),
            F.sum("y").alias("y"),
            F.count(F.lit(1)).cast("double").alias("c"),
            F.sum(F.col("t") * F.col("t")).alias("tt"),
        )
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    grouped = sums.groupBy("dimension", "level").agg(
        F.count(F.lit(1)).alias("clusters"),
        *[F.sum(a).alias(f"s_{a}") for a in names],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs],
    )
    n = F.col("s_c")
    mean_t, mean_y = F.col("s_t") / n, F.col("s_y") / n
    moments = grouped.select(
        "*",
        mean_t.alias("mt"),
        mean_y.alias("my"),
        (F.col("s_tt") - n * mean_t * mean_t).alias("spread"),
        (F.col("s_ty") - n * mean_t * mean_y).alias("joint"),
    ).withColumn("slope", F.when(F.col("spread") > 1e-12 * F.col("s_tt"), F.col("joint") / F.col("spread")))
    mt, my, slope = F.col("mt"), F.col("my"), F.col("slope")
    parts = {
        "ty": F.lit(1.0),
        "t": slope * mt * 2 - my,
        "y": -mt,
        "c": mt * my - slope * mt * mt,
        "tt": -slope,
    }
    squares = sum(
        (parts[a] * parts[b] * F.col(f"p_{a}_{b}") * (1 if a == b else 2) for a, b in pairs), F.lit(0.0)
    )
    clusters = F.col("clusters")
    error = F.sqrt(F.greatest(squares, F.lit(0.0)) * clusters / (clusters - 1)) / F.col("spread")
    return moments.select(
        "dimension",
        "level",
        n.cast("long").alias("n"),
        "clusters",
        "slope",
        F.when(clusters >= min_clusters, error).alias("std_error"),
    )


def shrunk_slopes(slopes: DataFrame) -> DataFrame:
    """``slopes`` with each drawn to its dimension's mean, as far as its error is large.

    The variance between the levels (``tau2``) is the moment estimate from the weighted
    squares around the mean; levels with a positive error decide it. A level without one is given
    the mean, and ``tau`` as its error. Columns tau2, shrunk_slope, shrunk_error.
    """
    v, b = F.col("std_error") * F.col("std_error"), F.col("slope")
    w = F.when(v > 0, 1 / v)
    totals = slopes.groupBy("dimension").agg(
        F.count(w).alias("k"),
        F.sum(w).alias("w"),
        F.sum(w * w).alias("ww"),
        F.sum(w * b).alias("wb"),
        F.sum(w * b * b).alias("wbb"),
    )
    centre = F.col("wb") / F.col("w")
    excess = F.col("wbb") - centre * F.col("wb") - (F.col("k") - 1)
    tau2 = F.try_divide(excess, F.col("w") - F.col("ww") / F.col("w"))
    totals = totals.select(
        "dimension", centre.alias("_centre"), F.greatest(F.coalesce(tau2, F.lit(0.0)), F.lit(0.0)).alias("tau2")
    )
    kept = F.col("tau2") / (F.col("tau2") + v)
    # One row a dimension.
    return slopes.join(F.broadcast(totals), "dimension").select(
        *slopes.columns,
        "tau2",
        F.when(w.isNull(), F.col("_centre")).otherwise(F.col("_centre") + kept * (b - F.col("_centre"))).alias("shrunk_slope"),
        F.sqrt(F.when(w.isNull(), F.col("tau2")).otherwise(kept * v)).alias("shrunk_error"),
    )


def slope_by_group(residuals: DataFrame, by: str) -> DataFrame:
    """Slope of the outcome residual on the treatment residual, per group."""
    y, t = F.col("outcome_residual"), F.col("treatment_residual")
    return (
        residuals.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.try_divide(F.covar_pop(t, y), F.var_pop(t)).alias("slope"),
        )
    )
