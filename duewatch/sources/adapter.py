"""Shape the generic order tables like a complaint population, so every operator can run on them.

Orders play complaints, customers play companies and documents play narratives. The label follows
from order status and priority; both are leakage columns here and never features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import StudyConfig

ORDER_STUDY = StudyConfig(
    start_year=1995,
    end_year=2000,
    train_years=(1995, 1996, 1997, 1998),
    validation_year=1999,
    test_year=2000,
    leakage_fields=("o_orderstatus", "o_orderpriority"),
    company_min_rows=10,
)

LATE = "o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"
LABEL = f"case when {LATE} then 1 else 0 end"
# Two scores in thousandths; each leans towards the label so that rankings are informative.
SCORE_MILLI = f"cast(floor(((o_orderkey * 7919) % 1000) * 0.7) as int) + case when {LATE} then 300 else 0 end"
SCORE_B_MILLI = (
    f"cast(floor(((o_orderkey * 104729) % 1000) * 0.8) as int) + case when {LATE} then 150 else 0 end"
)
SUB_PRODUCT = "case o_orderkey % 3 when 0 then null when 1 then 'General' else 'Other' end"
SUB_ISSUE = (
    "case when o_orderkey % 5 = 0 then null"
    " else concat('Detail ', cast(o_orderkey % 5 as string)) end"
)
CHANNEL = (
    "case when o_orderkey % 100 < 96 then 'Web' when o_orderkey % 100 < 98 then 'Phone'"
    " when o_orderkey % 100 < 99 then 'Referral' else 'Fax' end"
)
# The same facts as a raw export would spell them: odd casing, padding, bad dates, missing markers.
RAW_DATE = (
    "case o_orderkey % 97 when 0 then 'unknown' when 1 then '1996-13-45' when 2 then null"
    " else date_format(o_orderdate, 'yyyy-MM-dd') end"
)
RAW_ANSWER = (
    f"case when {LATE} then case o_orderkey % 4 when 0 then ' no' when 1 then 'NO\t' else 'No' end"
    " when o_orderkey % 11 = 0 then null else 'Yes' end"
)
RAW_SUB_PRODUCT = (
    "case o_orderkey % 7 when 0 then 'N/A' when 1 then '' when 2 then ' ' when 3 then 'None'"
    " when 4 then 'null' else 'General' end"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(
    spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Orders of the calendar years ``first..last``, by a range on the stored timestamp that
    Parquet can push down."""
    rows = table(spark, sf_dir, "orders")
    if first is None:
        return rows
    return rows.where(
        f"o_orderdate >= timestamp_ntz '{first}-01-01 00:00:00'"
        f" and o_orderdate < timestamp_ntz '{(last or first) + 1}-01-01 00:00:00'"
    )


def scored(
    spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Labels with two float scores. Needs orders only."""
    return orders(spark, sf_dir, first, last).selectExpr(
        "o_orderkey as complaint_id",
        "year(o_orderdate) as year",
        f"{LABEL} as target",
        f"cast(cast({SCORE_MILLI} as double) / 1000 as float) as score",
        f"cast(cast({SCORE_B_MILLI} as double) / 1000 as float) as score_b",
    )


def population(
    spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """The structured population: categories, calendar parts, label and narrative flag, no text."""
    narrated = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id")
    return (
        _with_parties(spark, sf_dir, orders(spark, sf_dir, first, last))
        .join(narrated, F.col("doc_id") == F.col("o_orderkey"), "left")
        .selectExpr(
            "o_orderkey as complaint_id",
            "cast(o_orderdate as date) as date_received",
            "c_mktsegment as product",
            f"{SUB_PRODUCT} as sub_product",
            "r_name as issue",
            f"{SUB_ISSUE} as sub_issue",
            "c_name as company",
            "n_name as state",
            f"{CHANNEL} as channel",
            "year(o_orderdate) as year",
            "month(o_orderdate) as month",
            "quarter(o_orderdate) as quarter",
            f"{LABEL} as target",
            "doc_id is not null as has_narrative",
            "o_orderstatus",
            "o_orderpriority",
        )
    )


def narratives(
    spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Texts keyed by complaint, with the complaint's year."""
    texts = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "text")
    keys = orders(spark, sf_dir, first, last).selectExpr(
        "o_orderkey as complaint_id", "year(o_orderdate) as year"
    )
    return texts.join(keys, F.col("doc_id") == F.col("complaint_id")).selectExpr(
        "complaint_id", "year", "text as narrative"
    )


def raw_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string rows as a raw export holds them, before any cleaning."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (
        _with_parties(spark, sf_dir, orders(spark, sf_dir))
        .join(texts, F.col("doc_id") == F.col("o_orderkey"), "left")
        .selectExpr(
            "cast(o_orderkey as string) as complaint_id",
            f"{RAW_DATE} as date_received",
            f"{RAW_ANSWER} as timely_response",
            "text as narrative",
            "c_mktsegment as product",
            f"{RAW_SUB_PRODUCT} as sub_product",
            "r_name as issue",
            f"{SUB_ISSUE} as sub_issue",
            "c_name as company",
            "n_name as state",
            f"{CHANNEL} as channel",
            "o_orderstatus",
            "o_orderpriority",
        )
    )


def _with_parties(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_name"
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        rows.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
