"""Calibration: do the scores match the observed rates?"""

from __future__ import annotations

import math
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions import clip_probability, row_count
from .ranking import edges_below, quantile_edges, ranked_runs, risk_group_of, score_ladder


def _risk_group(groups: int, rank: Column, rows: Column) -> Column:
    return risk_group_of(groups, rank, rows)


def risk_group_table(scored: DataFrame, groups: int = 10) -> DataFrame:
    """Observed and expected late cases per equal-sized risk group (0 is the lowest risk)."""
    p = clip_probability(F.col("score"))
    return (
        ranked_runs(scored, [partial(_risk_group, groups)])
        .groupBy(risk_group_of(groups).alias("risk_group"))
        .agg(
            F.sum("n").alias("cases"),
            F.sum("pos").alias("observed"),
            F.sum(p * F.col("n")).alias("expected"),
        )
        .withColumns(
            {
                "observed_rate": F.col("observed") / F.col("cases"),
                "expected_rate": F.col("expected") / F.col("cases"),
            }
        )
    )


def hosmer_lemeshow(risk_table: DataFrame, groups: int = 10) -> DataFrame:
    """Chi-square goodness of fit over a :func:`risk_group_table`, with degrees of freedom and p-value."""
    gap = F.pow(F.col("observed") - F.col("expected"), F.lit(2))
    spread = F.col("expected") * (1 - F.col("expected") / F.col("cases"))
    statistic = risk_table.agg(F.sum(F.try_divide(gap, spread)).alias("chi2"))
    return statistic.select(
        "chi2",
        F.lit(groups - 2).alias("dof"),
        chi_square_tail(F.col("chi2"), groups - 2).alias("p_value"),
    )


def chi_square_tail(chi2: Column, dof: int) -> Column:
    """Upper tail of the chi-square distribution, in closed form."""
    if dof <= 0:
        raise ValueError("the number of degrees of freedom must be positive")
    half = chi2 / 2
    odd = dof % 2
    series = F.lit(0.0)
    for k in range(dof // 2):
        power = k + odd / 2
        series = series + F.pow(half, F.lit(power)) / F.lit(math.gamma(power + 1))
    tail = F.exp(-half) * series
    return tail + _erfc(F.sqrt(half)) if odd else tail


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    """Complementary error function; only ever sees the one row of a test's result."""
    return x.map(math.erfc, na_action="ignore")


def top_bin_calibration(scored: DataFrame, sizes: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Mean score and observed rate in the top risk group, for several numbers of groups."""
    runs = ranked_runs(scored, [partial(_risk_group, q) for q in sizes])
    # A top group is a suffix of the ranking, so one pass over the runs serves every size.
    top = [risk_group_of(q) == q - 1 for q in sizes]
    p, n = F.col("score").cast("double"), F.col("n")
    row = runs.agg(
        F.array(
            *[
                F.struct(
                    F.lit(q).alias("bins"),
                    F.coalesce(F.sum(F.when(t, n)), F.lit(0)).alias("cases"),
                    F.try_divide(F.sum(F.when(t, p * n)), F.sum(F.when(t, n))).alias("mean_score"),
                    F.try_divide(F.sum(F.when(t, F.col("pos"))), F.sum(F.when(t, n))).alias("observed_rate"),
                )
                for q, t in zip(sizes, top)
            ]
        ).alias("tops")
    )
    return row.select(F.inline("tops"))


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in quantile bins of the score; empty bins are absent.

    A score equal to an inner edge belongs to the lower bin.
    """
    edges = quantile_edges(score_ladder(scored), bins, inner=True).first()[0]  # bins - 1 numbers
    p = F.col("score").cast("double")
    return (
        scored.groupBy(edges_below(edges, p).alias("bin"))
        .agg(
            row_count().alias("n"),
            F.avg(p).alias("mean_score"),
            F.avg("target").alias("observed_fraction"),
        )
    )


def brier_log_loss(scored: DataFrame) -> DataFrame:
    """Brier score, log loss, and mean prediction against the observed rate."""
    p, y = F.col("p"), F.col("target")
    measured = scored.select(clip_probability(F.col("score")).alias("p"), "target").agg(
        row_count().alias("n"),
        F.avg(F.pow(p - y, F.lit(2))).alias("brier"),
        F.avg(-F.when(y == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"),
        F.avg(p).alias("mean_predicted"),
        F.avg(y).alias("observed_rate"),
    )
    return measured.withColumn("overprediction", F.try_divide("mean_predicted", "observed_rate"))
