"""Complaint records shaped from the given star-schema and document tables.

``documents`` supplies the narratives; the other tables hang on ``doc_id`` by
left joins on unique keys, and only those that the asked columns need are
joined. Measures of the text are taken before any join, so the text itself is
shuffled only when it is asked for.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.functions.fields import has_text
from redressa.functions.text import STRUCTURE_MEASURES, TEXT_MEASURES, with_text_measures
from redressa.session import configure, spread
from redressa.sources.schema import CANONICAL_COLUMNS

CUTOFF = "1998-06-01"
REPLAY = "replay"
REPLAY_OFFSET = 1_000_000_000

_PRODUCTS = (
    "Debt collection",
    "Credit card or prepaid card",
    "Checking or savings account",
    "Mortgage",
    "Student loan",
    "Vehicle loan or lease",
    "Payday loan, title loan, or personal loan",
    "Money transfer, virtual currency, or money service",
    "Debt or credit management",
    None,
)
_MAIN_PRODUCT = "Credit reporting, credit repair services, or other personal consumer reports"

_TAILS = (
    " Pursuant to section 15 U.S.C 1681 this is a violation of my rights.",
    " Please help, XXXX charged {$1,200.50} on XX/XX/2022!",
    " See the attached police report and letter; they refuse?",
    " I lost my job and cannot pay rent. Thank you.",
)

_ORDERS = {"date_received", "company", "state", "company_response"}
_LABELS = {"timely_response", "consumer_disputed"}
_PARTS = {"issue", "sub_issue"}


def _choose(selector: Column, values: tuple, other: Column) -> Column:
    out = None
    for i, value in enumerate(values):
        hit = selector == i
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(other)


def _yes_no(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").when(flag == 0, "No")


def narratives(spark: SparkSession, sf_dir: str, replay: bool = False) -> DataFrame:
    """doc_id, complaint_id, ingest_seq, raw_source, consumer_narrative.

    With ``replay`` the complaints labelled toxic are sent a second time by
    another source, later and with another text: first-wins dedup drops them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    doc = F.col("doc_id")
    text = (
        F.when(doc % 31 == 0, F.lit(None).cast("string"))
        .when(doc % 29 == 0, F.lit("   "))
        .otherwise(F.concat(F.col("text"), _choose(doc % 8, _TAILS, F.lit(""))))
    )
    first = docs.select(
        doc,
        doc.cast("string").alias("complaint_id"),
        doc.alias("ingest_seq"),
        F.col("source").alias("raw_source"),
        text.alias("consumer_narrative"),
    )
    if not replay:
        return first
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    again = first.join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(
        "doc_id",
        "complaint_id",
        (F.col("ingest_seq") + REPLAY_OFFSET).alias("ingest_seq"),
        F.lit(REPLAY).alias("raw_source"),
        F.concat(F.lit("COPY "), F.coalesce("consumer_narrative", F.lit(""))).alias(
            "consumer_narrative"
        ),
    )
    return first.unionByName(again)


def _orders(spark: SparkSession, sf_dir: str, wanted: Collection[str]) -> DataFrame:
    """Orders by doc_id with the names that hang on the customer.

    They are joined here, to the narrow side, so that the complaint rows are
    partitioned by doc_id once for all their joins.
    """
    out = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderdate"
    )
    if "company" in wanted:
        # Only remainders are looked up, so few suppliers are asked and no order is shuffled for them.
        suppliers = (
            spark.read.parquet(f"{sf_dir}/supplier.parquet")
            .filter(F.col("s_suppkey").between(-9, 9))
            .select("s_suppkey", "s_name")
        )
        out = out.join(F.broadcast(suppliers), F.col("s_suppkey") == F.col("o_custkey") % 10, "left")
    if "state" in wanted:
        places = (
            spark.read.parquet(f"{sf_dir}/customer.parquet")
            .join(
                spark.read.parquet(f"{sf_dir}/nation.parquet"),
                F.col("c_nationkey") == F.col("n_nationkey"),
            )
            .select(F.col("c_custkey").alias("o_custkey"), "n_name")
        )
        out = out.join(places, "o_custkey", "left")
    return out


def complaint_rows(
    spark: SparkSession,
    sf_dir: str,
    columns: Collection[str] = CANONICAL_COLUMNS,
    replay: bool = True,
    measured: bool = True,
) -> DataFrame:
    """Raw complaints: ingest_seq, the canonical columns, has_narrative, text measures unless not ``measured``.

    Only the named ``columns`` (raw columns or text measures) are filled; the
    other raw columns are null, and the tables they come from are not read.
    """
    configure(spark)
    wanted = set(columns)
    base = narratives(spark, sf_dir, replay)
    if wanted & {"consumer_narrative", *TEXT_MEASURES, *STRUCTURE_MEASURES}:
        base = spread(base, "doc_id")
    base = base.withColumn("has_narrative", has_text(F.col("consumer_narrative")))
    base = with_text_measures(base) if measured else base

    doc = F.col("doc_id")
    out = base
    if wanted & _ORDERS:
        out = out.join(_orders(spark, sf_dir, wanted), "doc_id", "left")
    if "date_sent_to_company" in wanted:
        sent = (
            spark.read.parquet(f"{sf_dir}/lineitem.parquet")
            .groupBy(F.col("l_orderkey").alias("doc_id"))
            .agg(F.min("l_shipdate").alias("sent"))
        )
        out = out.join(sent, "doc_id", "left")
    if wanted & _PARTS:
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
            F.col("p_partkey").alias("doc_id"), "p_type", "p_brand"
        )
        out = out.join(parts, "doc_id", "left")
    if wanted & _LABELS:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
        out = out.join(labels, "doc_id", "left")

    response = (doc * 7 + F.col("o_custkey")) % 10
    shaped = {
        "date_received": lambda: F.col("o_orderdate").cast("timestamp"),
        "date_sent_to_company": lambda: F.col("sent").cast("timestamp"),
        "product": lambda: _choose(doc % 12, _PRODUCTS, F.lit(_MAIN_PRODUCT)),
        "issue": lambda: F.when(doc % 17 != 0, F.col("p_type")),
        "sub_issue": lambda: F.col("p_brand"),
        "company": lambda: F.col("s_name"),
        "state": lambda: F.when(doc % 13 != 0, F.col("n_name")),
        "submitted_via": lambda: _choose(doc % 3, ("Web", "Phone"), F.lit("Referral")),
        "company_response": lambda: F.when(response == 0, "Closed with monetary relief")
        .when(response.isin(1, 2), "Closed with non-monetary relief")
        .when(response == 8, "In progress")
        .when(response < 8, "Closed with explanation"),
        "timely_response": lambda: _yes_no(F.col("quality")),
        "consumer_disputed": lambda: _yes_no(F.col("toxic")),
    }
    own = {"complaint_id", "raw_source", *(wanted & {"consumer_narrative"})}
    picked = []
    for name in CANONICAL_COLUMNS:
        if name in own:
            picked.append(F.col(name))
        elif name in wanted and name in shaped:
            picked.append(shaped[name]().alias(name))
        else:
            kind = "timestamp" if name.startswith("date_") else "string"
            picked.append(F.lit(None).cast(kind).alias(name))
    measures = (*TEXT_MEASURES, *STRUCTURE_MEASURES) if measured else ()
    return out.select("ingest_seq", *picked, "has_narrative", *measures)
