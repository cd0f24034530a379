"""Session settings and the two places where data is written part-way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

SOURCE_TASKS = "redressa.source.tasks"

# What one task scans at most: the terms of its texts are summed in its memory, twenty times as large or more.
SCAN_BYTES = 32 << 20

_written: list[str] = []
_local_scratch: tempfile.TemporaryDirectory | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on, for the whole session: days in
    UTC, adaptive execution with skew joins, and scans of ``SCAN_BYTES`` a task, unless
    smaller ones are set. Registered queries call this first."""
    for name, value in _RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > SCAN_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SCAN_BYTES))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir`` (or through
    ``SparkContext.setCheckpointDir``). Only local mode may fall back to a
    temporary folder, because executors elsewhere could not read it; that one
    goes away with the process.
    """
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="redressa-", ignore_cleanup_errors=True)
    return _local_scratch.name


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared scratch folder, removed by ``release``."""
    path = f"{scratch_dir(spark)}/redressa-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: later passes neither recompute it
    nor depend on the executors that produced it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the scratch folders of ``tables``, which ``materialize`` returned.

    Only for tables that no later job reads.
    """
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def release(spark: SparkSession) -> None:
    """Delete every scratch folder this process has written.

    Results that are read lazily from them must have been stored before.
    """
    for path in list(_written):
        _delete(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def _file_system(spark: SparkSession, path: str):
    """The store behind ``path`` as Spark sees it, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)
    _written.remove(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` over as many tasks as the setting ``redressa.source.tasks`` asks for.

    Text measures are CPU-bound, and a small table often sits in one row group, hence in
    one task; a session that works on such tables names a number. Without the setting
    the scan's own splits stay, and the text is never shuffled.
    """
    tasks = df.sparkSession.conf.get(SOURCE_TASKS, None)
    return df.repartition(int(tasks), *keys) if tasks else df
