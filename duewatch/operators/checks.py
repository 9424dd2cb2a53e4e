"""Published claims as assertions: one row per check with expected, actual and passed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Claims


def _check(name: str, expected: str, actual: Column, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"),
        F.lit(expected).alias("expected"),
        actual.cast("double").alias("actual"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _rows(table: DataFrame, *checks: Column) -> DataFrame:
    return table.select(F.inline(F.array(*checks)))


def check_duplicate_ids(duplicates: DataFrame) -> DataFrame:
    """No complaint id occurs twice."""
    d = F.col("duplicates")
    return _rows(duplicates, _check("duplicate ids", "0", d, d == 0))


def check_pr_midrange(points: DataFrame, low: float = 0.10, high: float = 0.15) -> DataFrame:
    """Precision at the five middle recalls stays within a band."""
    spread = points.agg(F.min("precision").alias("lo"), F.max("precision").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return _rows(
        spread,
        _check("lowest mid-range precision", f">= {low}", lo, lo >= low),
        _check("highest mid-range precision", f"<= {high}", hi, hi <= high),
        _check("mid-range precision in band", f"{low} to {high}", hi - lo, (lo >= low) & (hi <= high)),
    )


def check_roc_shape(points: DataFrame) -> DataFrame:
    """High detection at a low alarm rate, both ways round."""
    tpr, fpr = F.col("tpr_at_fpr"), F.col("fpr_at_tpr")
    return _rows(
        points,
        _check("TPR at FPR 0.10", "> 0.9", tpr, tpr > 0.9),
        _check("FPR at TPR 0.90", "< 0.1", fpr, fpr < 0.1),
    )


def check_score_bands(bands: DataFrame, above_expected: int) -> DataFrame:
    """Late cases at or above 0.6 number as published; the bands add up."""
    total = F.col("below") + F.col("between") + F.col("above")
    return _rows(
        bands,
        _check("untimely at or above 0.6", str(above_expected), F.col("above"),
               F.col("above") == above_expected),
        _check("bands cover all untimely", "total", total, total == F.col("untimely_total")),
        _check("share between 0.1 and 0.6", "> 0", F.col("between_share"), F.col("between_share") > 0),
    )


def check_feature_count(counted: DataFrame, expected: int) -> DataFrame:
    total = F.col("total")
    return _rows(counted, _check("encoded features", str(expected), total, total == expected))


def check_text_subset(
    stats: DataFrame, records: int, pct: float, rate_pct: float, digits: int = 2
) -> DataFrame:
    n, p, r = F.col("narrative_records"), F.col("narrative_pct"), F.col("untimely_rate_pct")
    return _rows(
        stats,
        _check("narrative rows in training", str(records), n, n == records),
        _check("narrative share of training, %", str(pct), p, F.round(p, digits) == pct),
        _check("untimely rate in subset, %", str(rate_pct), r, F.round(r, digits) == rate_pct),
    )


def check_calibration(top_bins: DataFrame, summary: DataFrame, flagged_expected: int) -> DataFrame:
    """Top risk groups predict more than is observed; the flagged count is as published."""
    p, o = F.col("mean_score"), F.col("observed_rate")
    tops = top_bins.select(
        F.concat(F.lit("top of "), F.col("bins").cast("string"), F.lit(" groups overpredicts")).alias("check"),
        F.lit("> 1").alias("expected"),
        F.try_divide(p, o).alias("actual"),
        F.coalesce(p > o, F.lit(False)).alias("passed"),
    )
    n = F.col("flagged")
    flagged = _rows(summary, _check("rows at or above 0.6", str(flagged_expected), n, n == flagged_expected))
    return tops.unionByName(flagged)


def check_uniform_bins(bins: DataFrame) -> DataFrame:
    """Each occupied bin of equal width predicts more than is observed."""
    p, o = F.col("mean_score"), F.col("observed_rate")
    return bins.select(
        F.concat(F.lit("bin "), F.col("bin").cast("string"), F.lit(" of equal width overpredicts")).alias("check"),
        F.lit("> 1").alias("expected"),
        F.try_divide(p, o).alias("actual"),
        F.coalesce(p > o, F.lit(False)).alias("passed"),
    )


def check_sizes(study: DataFrame, sample: DataFrame, test: DataFrame, claims: Claims) -> DataFrame:
    """Rows and late cases of the population, the training sample and the test year."""
    rows, late = F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0))
    counted = (
        study.agg(rows.alias("study"))
        .withColumn("train", sample.agg(F.struct(rows.alias("n"), late.alias("pos"))).scalar())
        .withColumn("test", test.agg(F.struct(rows.alias("n"), late.alias("pos"))).scalar())
    )

    def exact(name: str, expected: float, actual: Column, digits: int = 0) -> Column:
        return _check(name, str(expected), actual, F.round(actual.cast("double"), digits) == expected)

    share = lambda part: F.try_divide(F.col(f"{part}.pos"), F.col(f"{part}.n"))
    return _rows(
        counted,
        exact("study records", claims.study_records, F.col("study")),
        exact("training rows", claims.training_rows, F.col("train.n")),
        exact("untimely training rows", claims.training_positives, F.col("train.pos")),
        exact("untimely share of training, %", claims.training_pct, 100 * share("train"), 2),
        exact("test records", claims.test_records, F.col("test.n")),
        exact("untimely test records", claims.test_positives, F.col("test.pos")),
        exact("no-skill precision", claims.no_skill, share("test"), 4),
    )


def check_source_rows(counted: DataFrame, chunks: int) -> DataFrame:
    c = F.col("chunks")
    return _rows(counted, _check("source chunks", str(chunks), c, c == chunks))


def baseline_gate(metrics: DataFrame, expected: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Compare (period, metric, value) with the expected values, within a relative tolerance."""
    pairs = expected.withColumnRenamed("value", "want").join(metrics, ["period", "metric"], "left")
    want, have = F.col("want"), F.col("value")
    return pairs.select(
        F.concat_ws(" ", F.col("period").cast("string"), "metric").alias("check"),
        want.cast("string").alias("expected"),
        have.alias("actual"),
        F.coalesce(F.abs(have - want) <= tolerance * want, F.lit(False)).alias("passed"),
    )


def long_metrics(ablation: DataFrame, variant: str = "baseline") -> DataFrame:
    """Recall and PR-AUC of one ablation variant as (period, metric, value)."""
    return ablation.where(F.col("variant") == variant).select(
        "period",
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("recall", "pr_auc")]
            )
        ),
    )


def expected_metrics(spark: SparkSession, values: Sequence[tuple[int, float, float]]) -> DataFrame:
    """Expected (period, recall, PR-AUC) triples as (period, metric, value)."""
    rows = [
        (period, metric, float(value))
        for period, recall, pr_auc in values
        for metric, value in (("recall", recall), ("pr_auc", pr_auc))
    ]
    return spark.createDataFrame(rows, "period int, metric string, value double")


def require(checks: DataFrame, message: str) -> None:
    """Stop when a gate did not pass. Check tables hold a few rows."""
    failed = [r.check for r in checks.where(~F.col("passed")).collect()]
    if failed:
        raise RuntimeError(f"{message}: {failed}")


def all_checks(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
