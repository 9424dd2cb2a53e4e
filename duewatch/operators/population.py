"""From raw strings to the study population, its periods and its guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import StudyConfig
from ..functions import days_between_years, is_late, parse_date


def with_calendar(df: DataFrame, date: str = "date_received") -> DataFrame:
    """Parse the date, drop rows without one, add year, month and quarter."""
    parsed = df.withColumn(date, parse_date(F.col(date))).where(F.col(date).isNotNull())
    return parsed.withColumns(
        {
            "year": F.year(date),
            "month": F.month(date),
            "quarter": F.quarter(date),
        }
    )


def derive_population(raw: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Study-period rows with calendar parts, label and narrative flag; text is still attached."""
    dated = with_calendar(raw)
    in_scope = dated.where(days_between_years(F.col("date_received"), cfg.start_year, cfg.end_year))
    return in_scope.withColumns(
        {
            "target": is_late(F.col("timely_response")),
            "has_narrative": F.col("narrative").isNotNull(),
        }
    )


def drop_leakage(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Remove fields that are only known after the response, and refuse a feature list with one."""
    leaking = set(cfg.features) & set(cfg.leakage_fields)
    if leaking:
        raise ValueError(f"post-response fields used as features: {sorted(leaking)}")
    return df.drop(*cfg.leakage_fields)


def leakage_report(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per guarded field: was it present, and is it gone now?"""
    kept = set(drop_leakage(df, cfg).columns)
    rows = [(name, name in df.columns, name not in kept) for name in cfg.leakage_fields]
    flags = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.lit(p).alias("present"), F.lit(g).alias("removed"))
            for n, p, g in rows
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("rows_kept"))
    return counted.select(F.inline(flags), "rows_kept")


def period(cfg: StudyConfig, year: str = "year") -> Column:
    """Which part of the temporal split a year belongs to; null outside the study."""
    column = F.col(year)
    return (
        F.when(column.isin(*cfg.train_years), "train")
        .when(column == cfg.validation_year, "validation")
        .when(column == cfg.test_year, "test")
    )


def temporal_split(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Label every study row with its period."""
    return df.withColumn("period", period(cfg)).where(F.col("period").isNotNull())


def in_years(df: DataFrame, years: Iterable[int]) -> DataFrame:
    """Rows of the given years; prunes partitions on a year-partitioned table."""
    return df.where(F.col("year").isin(*years))


def year_variant(df: DataFrame, variant: str, cfg: StudyConfig) -> DataFrame:
    """The year feature as it is, removed, or held at its last training value."""
    if variant == "baseline":
        return df
    if variant == "dropped":
        return df.drop("year")
    if variant == "capped":
        return df.withColumn("year", F.least("year", F.lit(cfg.last_train_year)))
    raise ValueError(f"unknown year variant {variant!r}")
