"""Sinks. All writes are distributed; a path is a folder of part files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from redressa.session import path_exists


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None):
    """Overwrite ``path`` with ``df`` as parquet, csv or json.

    Rows of a partitioned table are first brought together by partition, big
    ones split, so that not every task writes a small file into every folder.
    """
    if partition_by:
        writer = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
    else:
        writer = df.write
    writer = writer.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        (
            writer.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unsupported format: {fmt!r}")


def write_once(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Keep a finished copy of a source unless ``force``; return the copy.

    A copy is finished when its success marker is there; what an interrupted run left
    is written anew.
    """
    if force or not path_exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_record(spark: SparkSession, record: dict, path: str):
    """One small summary record as a JSON text file."""
    text = json.dumps(record, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
