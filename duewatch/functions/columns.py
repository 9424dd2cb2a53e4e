"""Column expressions shared by the operators. All are JVM-side built-ins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MISSING_LEVEL, NA_TOKENS


def row_count() -> Column:
    return F.count(F.lit(1))


def as_missing(column: Column) -> Column:
    """Null out the strings a CSV reader treats as missing; anything else is kept as is."""
    return F.when(~column.isin(*NA_TOKENS), column)


def parse_date(column: Column) -> Column:
    """ISO date, or null where the text is not one."""
    return F.try_to_date(column, "yyyy-MM-dd")


def days_between_years(column: Column, first: int, last: int) -> Column:
    """Range predicate on the date itself, which Parquet can push down (``year(x)`` cannot)."""
    return (column >= F.lit(f"{first}-01-01").cast("date")) & (
        column < F.lit(f"{last + 1}-01-01").cast("date")
    )


def is_late(column: Column) -> Column:
    """1 where the timely-response answer is "no" in any case or padding, else 0 (also for null)."""
    stripped = F.regexp_replace(column, r"^\s+|\s+$", "")
    return F.coalesce(F.lower(stripped) == "no", F.lit(False)).cast("int")


def fill_missing_levels(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Give null categories an explicit level; an absent column becomes that level throughout."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(MISSING_LEVEL))
        if name in df.columns
        else F.lit(MISSING_LEVEL)
        for name in columns
    }
    return df.withColumns(filled)


def clip_probability(column: Column) -> Column:
    """Keep a probability off 0 and 1 so its logarithm is finite."""
    return F.least(F.greatest(column.cast("double"), F.lit(1e-15)), F.lit(1.0 - 1e-15))


def passes(df: DataFrame, score: str, threshold: float) -> Column:
    """``score >= threshold`` in the score's own precision (a float score meets a float cut)."""
    return F.col(score) >= F.lit(threshold).cast(df.schema[score].dataType)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields null for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def uniform_bin(column: Column, bins: int) -> Column:
    """Left-closed bin of [0, 1] with edges ``i * (1/bins)``; the last bin also holds 1."""
    step = F.lit(1.0 / bins)
    value = column.cast("double")
    guess = F.floor(value * bins)
    index = (
        F.when(value >= (guess + 1) * step, guess + 1)
        .when(value < guess * step, guess - 1)
        .otherwise(guess)
    )
    return F.greatest(F.least(index, F.lit(bins - 1)), F.lit(0)).cast("int")
