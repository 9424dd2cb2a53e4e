"""Data-quality and volume tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import StudyConfig
from ..functions import row_count, safe_ratio


def _percent(part: Column, whole: Column) -> Column:
    return safe_ratio(100 * part, whole)


def _year_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(
        row_count().alias("complaints"), F.sum("target").cast("bigint").alias("untimely")
    )


def study_population_by_year(df: DataFrame) -> DataFrame:
    """Volume and late rate per year, with a grand-total row; the year becomes text."""
    # The rollup runs over one row per year, not over the population.
    totals = (
        _year_counts(df)
        .rollup("year")
        .agg(
            F.sum("complaints").cast("bigint").alias("complaints"),
            F.sum("untimely").cast("bigint").alias("untimely"),
            F.grouping("year").alias("is_total"),
        )
    )
    everything = F.max(F.when(F.col("is_total") == 1, F.col("complaints"))).over(
        Window.partitionBy(F.lit(0))
    )
    return totals.select(
        F.when(F.col("is_total") == 1, "Total").otherwise(F.col("year").cast("string")).alias("year"),
        "complaints",
        "untimely",
        _percent(F.col("complaints"), everything).alias("share_pct"),
        _percent(F.col("untimely"), F.col("complaints")).alias("untimely_rate_pct"),
    )


def yearly_rates(table: DataFrame) -> DataFrame:
    """The yearly rows of :func:`study_population_by_year`, with the year as a number again."""
    return table.where(F.col("year") != "Total").withColumn("year", F.col("year").cast("int"))


# Audited fields and their published names.
AUDITED = (
    ("date_received", "Date received"),
    ("product", "Product"),
    ("company", "Company"),
    ("channel", "Submitted via"),
    ("complaint_id", "Complaint ID"),
    ("target", "Timely response?"),
)


def missingness(df: DataFrame) -> DataFrame:
    """Null counts per audited field, in one pass. The label is measured too."""
    absent = [
        F.struct(
            F.lit("Consumer complaint narrative").alias("field"),
            F.count_if(~F.col("has_narrative")).alias("missing"),
        )
    ] + [
        F.struct(
            F.lit(label).alias("field"),
            F.count_if(F.col(name).isNull()).alias("missing"),
        )
        for name, label in AUDITED
        if name in df.columns
    ]
    counted = df.agg(row_count().alias("n"), F.array(*absent).alias("fields"))
    return counted.select("n", F.inline("fields")).select(
        "field", "missing", _percent(F.col("missing"), F.col("n")).alias("missing_pct")
    )


def narrative_availability_by_year(df: DataFrame) -> DataFrame:
    """How many complaints of each year carry a narrative."""
    counts = df.groupBy("year").agg(
        F.count_if(F.col("has_narrative")).alias("sum"), row_count().alias("size")
    )
    return counts.withColumn("availability_pct", _percent(F.col("sum"), F.col("size")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per level, null included, largest first, with shares of the whole."""
    counts = df.groupBy(column).agg(row_count().alias("count"))
    # The total is a scalar subquery over the same small table of level counts.
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share_pct", _percent(F.col("count"), total)).orderBy(
        F.desc("count"), F.asc(column)
    )


def head(table: DataFrame, rows: int) -> DataFrame:
    """The leading rows of an ordered table (a top-k, not a full sort)."""
    return table.limit(rows)


def duplicate_ids(df: DataFrame, key: str = "complaint_id") -> DataFrame:
    """Rows beyond the first of each key; a null key is a key like any other."""
    copies = df.groupBy(key).agg(row_count().alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("records"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    )


def period_stats(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Size and late rate of the validation and test years; a year without rows is absent."""
    label = F.when(F.col("year") == cfg.validation_year, "validation").when(
        F.col("year") == cfg.test_year, "test"
    )
    years = _year_counts(df.where(F.col("year").isin(cfg.validation_year, cfg.test_year)))
    return years.select(
        label.alias("period"),
        "year",
        F.col("complaints").alias("records"),
        "untimely",
        _percent(F.col("untimely"), F.col("complaints")).alias("untimely_rate_pct"),
    )


def split_design(sample: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row that documents the training sample."""
    return sample.agg(
        F.lit("train").alias("period"),
        F.lit(str(list(cfg.train_years))).alias("years"),
        row_count().alias("records"),
        F.coalesce(F.sum("target"), F.lit(0)).cast("bigint").alias("untimely"),
        (100 * F.avg("target")).alias("untimely_rate_pct"),
        F.lit(f"all positives + {cfg.negatives_per_positive} negatives each").alias("sampling"),
    )


def rate_table(df: DataFrame, key: str, min_rows: int = 1) -> DataFrame:
    """Volume and late rate per level of ``key``, null levels left out, largest first."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(row_count().alias("complaints"), F.sum("target").cast("bigint").alias("untimely"))
        .where(F.col("complaints") >= min_rows)
        .withColumn("untimely_rate", F.round(safe_ratio(F.col("untimely"), F.col("complaints")), 6))
        .orderBy(F.desc("complaints"), F.asc(key))
    )


def dim_year(df: DataFrame) -> DataFrame:
    """Yearly rates in calendar order, with each year's share of all complaints."""
    years = rate_table(df, "year")
    total = F.sum("complaints").over(Window.partitionBy(F.lit(0)))  # one row per year
    share = F.round(safe_ratio(F.col("complaints"), total), 6)
    return years.withColumn("share_of_total", share).orderBy("year")


def dim_company(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The largest companies above a volume floor."""
    return rate_table(df, "company", cfg.company_min_rows).limit(cfg.top_companies)


def dim_product(df: DataFrame) -> DataFrame:
    return rate_table(df, "product")


def text_subset_stats(sample: DataFrame, flag: str = "has_narrative") -> DataFrame:
    """How much of the training sample has text, and how often that part is late."""
    with_text = F.count_if(F.col(flag))
    late = F.count_if(F.col(flag) & (F.col("target") == 1))
    return sample.agg(
        row_count().alias("records"),
        with_text.alias("narrative_records"),
        _percent(with_text, row_count()).alias("narrative_pct"),
        _percent(late, with_text).alias("untimely_rate_pct"),
    )
