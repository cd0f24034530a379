"""Train/test splits and folds that need no global sort of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the hash that name a bucket: 16^4 buckets.
_BUCKET_DIGITS = 4
# Class counts that a gate's record names; the verdict does not depend on it.
SHOWN_CLASSES = 100


def seeded_hash(key: str, seed: int) -> Column:
    """Hex digest of the key with a seed; a null key hashes like an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class of a target, null targets left out."""
    return (
        df.filter(F.col(target).isNotNull())
        .groupBy(F.col(target).cast("int").alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def gate_columns(counts: DataFrame, by: str, min_class: int = 30) -> DataFrame:
    """Append ``status`` to class counts: 'fit' for two classes of ``min_class`` rows or more.

    Other targets are 'skipped', and those of more than two classes 'not binary'.
    """
    verdict = counts.groupBy(by).agg(
        F.count(F.lit(1)).alias("_classes"), F.min("n").alias("_least")
    )
    status = (
        F.when(F.col("_classes") > 2, "not binary")
        .when((F.col("_classes") == 2) & (F.col("_least") >= min_class), "fit")
        .otherwise("skipped")
    )
    return counts.join(verdict.select(by, status.alias("status")), by)


def class_gate(df: DataFrame, target: str, min_class: int = 30) -> dict:
    """Whether a binary model can be fitted, with the counts of up to ``SHOWN_CLASSES``
    classes, rarest first. The verdict is on all of them."""
    counts = class_counts(df, target).withColumn("target", F.lit(target))
    rows = gate_columns(counts, "target", min_class).orderBy("n", "class").limit(SHOWN_CLASSES)
    shown = rows.collect()
    status = shown[0]["status"] if shown else "skipped"
    record = {
        "target": target,
        "status": "fit" if status == "fit" else "skipped",
        "class_counts": {str(r["class"]): r["n"] for r in sorted(shown, key=lambda r: r["class"])},
    }
    if status == "not binary":
        record["reason"] = "more than two classes"
    elif status == "skipped":
        record["reason"] = f"fewer than two classes, or one with under {min_class} rows"
    return record


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """Weight n / (classes * rows of the class) for each class."""
    counts = class_counts(df, target)
    totals = counts.agg(
        F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    ).scalar()
    weight = totals["n"].cast("double") / (totals["classes"] * F.col("n"))
    return counts.withColumn("weight", weight)


def class_quotas(counts: DataFrame, test_share: float) -> DataFrame:
    """Test rows per class, from class counts.

    The train total is n - ceil(share * n). Each class gets the floor of its
    proportional part; what is missing goes to the largest remainders.
    """
    n = counts.agg(F.sum("n")).scalar()
    n_train = n - F.ceil(n * F.lit(test_share))
    by_remainder = Window.orderBy(F.desc("_remainder"), F.asc("class"))
    return (
        counts.withColumn("_exact", F.col("n") * n_train.cast("double") / n)
        .withColumn("_floor", F.floor("_exact"))
        .withColumn("_remainder", F.col("_exact") - F.col("_floor"))
        .withColumn("_missing", n_train - F.sum("_floor").over(Window.partitionBy()))
        .withColumn("_rank", F.row_number().over(by_remainder))
        .withColumn(
            "train", F.col("_floor") + (F.col("_rank") <= F.col("_missing")).cast("int")
        )
        .select("class", (F.col("n") - F.col("train")).alias("quota"))
    )


def stratified_split(
    df: DataFrame, target: str, key: str, test_share: float = 0.25, seed: int = 42
) -> DataFrame:
    """Append ``part`` ('train' or 'test') with exact shares per class.

    The test rows of a class are those with the smallest seeded hashes. A
    histogram over hash buckets finds the bucket where the quota ends; only
    that bucket's rows are ranked, to find the last test row. The full table
    is then labelled by comparing hashes, without a shuffle.
    """
    digest, bucket = seeded_hash(key, seed), F.substring("_hash", 1, _BUCKET_DIGITS)
    usable = df.filter(F.col(target).isNotNull())
    narrow = usable.select(
        F.col(target).cast("int").alias("class"),
        digest.alias("_hash"),
        F.col(key).cast("string").alias("_key"),
    ).withColumn("_bucket", bucket)

    histogram = narrow.groupBy("class", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = histogram.groupBy("class").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("class").orderBy("_bucket")
    edges = (
        histogram.withColumn("_upto", F.sum("n").over(running))
        .join(F.broadcast(class_quotas(counts, test_share)), "class")
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("n") < F.col("quota")))
        .select("class", "_bucket", (F.col("quota") - F.col("_upto") + F.col("n")).alias("_left"))
    )
    in_bucket = Window.partitionBy("class").orderBy("_hash", "_key")
    last = (
        narrow.join(F.broadcast(edges), ["class", "_bucket"])
        .withColumn("_rank", F.row_number().over(in_bucket))
        .filter(F.col("_rank") == F.col("_left"))
        .select("class", F.struct("_hash", "_key").alias("_last"))
    )
    place = F.struct(digest.alias("_hash"), F.col(key).cast("string").alias("_key"))
    return (
        usable.join(F.broadcast(last), F.col(target).cast("int") == F.col("class"), "left")
        .withColumn("part", F.when(place <= F.col("_last"), "test").otherwise("train"))
        .drop("class", "_last")
    )


def time_split(df: DataFrame, date: str, test_share: float = 0.25) -> DataFrame:
    """Append ``part`` by day: train up to the first day that completes the train share.

    Only the histogram of days is sorted, and the calendar bounds its size.
    Rows without a date go to neither part.
    """
    day = F.unix_date(F.col(date).cast("date"))
    per_day = (
        df.filter(F.col(date).isNotNull())
        .groupBy(day.alias("_day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = per_day.agg(F.sum("n")).scalar()
    running = per_day.withColumn("_upto", F.sum("n").over(Window.orderBy("_day")))
    cut = running.filter(F.col("_upto") >= total * F.lit(1.0 - test_share)).agg(F.min("_day"))
    last = cut.scalar()
    return df.withColumn("part", F.when(day <= last, "train").when(day > last, "test"))


def cv_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Append ``fold`` in 0..k-1 from a seeded hash of the key."""
    digits = F.substring(seeded_hash(key, seed), 1, 7)
    return df.withColumn("fold", (F.conv(digits, 16, 10).cast("int") % k).cast("int"))
