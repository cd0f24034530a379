"""Scans of raw complaint records: CSV, Parquet and the search-API envelope."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redressa.sources import records

INGEST = "ingest_seq"
HEADERS_AT_ONCE = 16
# Longer CSV files are cut into records by many tasks.
WHOLE_BYTES = 128 << 20


def _with_ingest_order(df: DataFrame, source_no: int) -> DataFrame:
    """Add the position of each row: source, file, block, row within block.

    Ids alone would not do: Spark packs file splits by size, not by name.
    """
    return df.select(
        "*",
        F.struct(
            F.lit(source_no).alias("source_no"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(INGEST),
    )


def _csv(spark: SparkSession) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
    )


def file_sizes(spark: SparkSession, paths: Sequence[str]) -> dict[str, int]:
    """Names and lengths of the files behind ``paths``; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    rows = listed.filter("length > 0").select("path", "length").collect()
    return {r["path"]: r["length"] for r in sorted(rows)}


def _in_blocks(spark: SparkSession, files: Sequence[str], header: Sequence[str], source_no: int) -> list[DataFrame]:
    """Rows of files that many tasks read each, block by block; files with irregular quotes as a whole."""
    lines = records.file_lines(spark, files)
    known = records.block_parities(lines)
    if known is None:
        return [_whole(spark, files, header, source_no)]
    inside, irregular = known
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    if irregular:
        regular = F.col("file").isin(sorted(set(inside) - irregular))
        lines = lines.filter(regular)
    found = records.file_records(lines, inside)
    row = F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true"})
    place = F.struct(F.lit(source_no).alias("source_no"), "file", "block", "row").alias(INGEST)
    parts = [found.select(row.alias("_row"), place).select("_row.*", INGEST)]
    return parts + ([_whole(spark, sorted(irregular), header, source_no)] if irregular else [])


def _whole(spark: SparkSession, files: Sequence[str], header: Sequence[str], source_no: int) -> DataFrame:
    """Rows of files that one task reads each."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return _with_ingest_order(_csv(spark).schema(schema).csv(list(files)), source_no)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], source_no: int = 0, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """CSV with header rows; quotes are doubled inside quoted multi-line text.

    Files with the same header are read together, and the groups are united by column
    name: Spark alone would take the first file's header for all. Only headers are
    looked at for this, one small read a file.

    A file longer than ``whole_bytes`` is cut into records by many tasks, at the
    price of a second scan that counts quotes; shorter ones are read by a task each. The rows are the same, but for carriage returns
    inside texts of files whose own lines end with them: Spark's scan of a whole file drops those.
    """
    sizes = file_sizes(spark, [path] if isinstance(path, str) else list(path))
    files = list(sizes)
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda f: tuple(_csv(spark).csv(f).columns), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files, strict=True):
        groups.setdefault(header, []).append(file)
    parts = []
    for header, same in groups.items():
        short = [f for f in same if sizes[f] <= whole_bytes]
        parts += [_whole(spark, short, header, source_no)] if short else []
        if len(short) < len(same):
            parts += _in_blocks(spark, [f for f in same if sizes[f] > whole_bytes], header, source_no)
    if not parts:
        raise ValueError(f"no CSV file with a header in {path!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_parquet(spark: SparkSession, path: str | Sequence[str], source_no: int = 0) -> DataFrame:
    """Parquet files or folders, whose columns may differ: united by name."""
    paths = [path] if isinstance(path, str) else list(path)
    return _with_ingest_order(spark.read.option("mergeSchema", True).parquet(*paths), source_no)


def read_table(
    spark: SparkSession, path: str | Sequence[str], fmt: str, source_no: int = 0
) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, source_no)
    if fmt == "parquet":
        return read_parquet(spark, path, source_no)
    raise ValueError(f"unsupported format: {fmt!r}")


def read_hits(
    spark: SparkSession, path: str, fields: Sequence[str], one_per_line: bool = False
) -> DataFrame:
    """Records of search-API replies, one reply per file or per line.

    A reply holds its items under ``hits.hits`` or directly under ``hits``; an
    item is a record, or wraps one in ``_source``. Items that are no objects
    are dropped.
    """
    reply = T.StructType().add("hits", T.StringType())
    nested = T.StructType().add("hits", T.ArrayType(T.StringType()))
    item = T.StructType().add("_source", T.StringType())
    record = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    body = F.col("hits")
    items = F.when(
        body.startswith("["), F.from_json(body, T.ArrayType(T.StringType()))
    ).otherwise(F.from_json(body, nested)["hits"])
    return (
        spark.read.schema(reply)
        .option("multiLine", not one_per_line)
        .json(path)
        .select(F.explode(items).alias("item"))
        .filter(F.col("item").startswith("{"))
        .select(
            F.from_json(
                F.coalesce(F.from_json("item", item)["_source"], F.col("item")), record
            ).alias("record")
        )
        .select("record.*")
    )
