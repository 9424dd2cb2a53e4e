"""Equi-joins between samples, texts, labels and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = "complaint_id"


def wanted_narratives(sample: DataFrame, narratives: DataFrame) -> DataFrame:
    """Texts of the sampled complaints that have one."""
    keys = sample.where(F.col("has_narrative")).select(KEY)
    return narratives.join(keys, KEY, "left_semi")


def attach_narratives(sample: DataFrame, narratives: DataFrame) -> DataFrame:
    """Every sampled row, with its text or null. Sample first: only those texts are joined."""
    texts = wanted_narratives(sample, narratives).select(KEY, "narrative")
    return sample.join(texts, KEY, "left")


def narrative_subset(rows: DataFrame, narratives: DataFrame) -> DataFrame:
    """Only the rows with text, text attached."""
    return rows.join(narratives.select(KEY, "narrative"), KEY)


def align_scores(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Labels and scores matched by complaint."""
    return labels.join(scores, KEY)


def alignment_report(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Do labels and scores cover exactly the same complaints?"""
    # Counting copies per key instead of joining: a repeated or null key stays one row per task.
    sides = labels.select(KEY, F.lit(1).alias("l"), F.lit(0).alias("s")).unionAll(
        scores.select(KEY, F.lit(0).alias("l"), F.lit(1).alias("s"))
    )
    keys = sides.groupBy(KEY).agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    both = F.col(KEY).isNotNull() & (F.col("l") > 0) & (F.col("s") > 0)
    total = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
    return keys.agg(
        total(F.when(both, F.col("l"))).alias("matched"),
        total(F.when(~both, F.col("l"))).alias("labels_only"),
        total(F.when(~both, F.col("s"))).alias("scores_only"),
    ).withColumn("complete", (F.col("labels_only") == 0) & (F.col("scores_only") == 0))
