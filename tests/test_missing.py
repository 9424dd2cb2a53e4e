"""Missing ids and scores, staged folders, and groups read off the ladder."""

import os
import random

import pytest
from pyspark.sql import functions as F

from duewatch.config import StudyConfig
from duewatch.operators import calibration, metrics, ranking, sampling
from duewatch.session import stage, staging
from duewatch.sources import read_scored_file

SCORED = "complaint_id long, target int, score float"


def test_rows_without_an_id_do_not_inflate_the_sample(spark):
    rows = [(i, 1) for i in range(10)] + [(100 + i, 0) for i in range(190)] + [(None, 0)] * 7
    pool = spark.createDataFrame(rows, "complaint_id long, target int")
    sample = sampling.undersample_negatives(pool, StudyConfig())
    assert {r.target: r["count"] for r in sample.groupBy("target").count().collect()} == {1: 10, 0: 50}


@pytest.mark.parametrize("missing", [None, float("nan")])
@pytest.mark.parametrize("measure", [
    lambda df: ranking.score_ladder(df),
    lambda df: metrics.metrics_at_thresholds(df, [0.5]),
    lambda df: ranking.triage_queue(df, 2, 0.5),
    lambda df: ranking.decile_lift(df),
])
def test_missing_scores_are_refused(spark, missing, measure):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, missing), (3, 1, 0.2)], SCORED)
    with pytest.raises(Exception, match="score is missing"):
        measure(df).collect()


def test_one_scan_serves_the_ladder(spark, tmp_path):
    spark.range(1000).select(
        F.col("id").alias("complaint_id"), (F.col("id") % 7 == 0).cast("int").alias("target"), (F.rand(1)).cast("float").alias("score")
    ).write.parquet(f"{tmp_path}/scored")
    ladder = ranking.score_ladder(spark.read.parquet(f"{tmp_path}/scored"))
    ladder.collect()
    final = ladder._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_scored_file_with_missing_markers(spark, tmp_path):
    (tmp_path / "scored.csv").write_text("pred_proba,actually_untimely\n0.5,1\nNA,0\nnan,NA\n,1\nodd,0\n0.25,\n")
    rows = [(r.pred_proba, r.actually_untimely) for r in read_scored_file(spark, str(tmp_path / "scored.csv")).collect()]
    assert rows == [(0.5, 1), (None, 0), (None, None), (None, 1), (None, 0), (0.25, None)]


def test_a_run_leaves_no_staged_tables(spark):
    with staging(spark, "outer") as folder:
        kept = stage(spark.range(5), "numbers")
        assert kept.count() == 5 and os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


@pytest.mark.parametrize("distinct", [1, 3, 40, 10_000])
def test_groups_off_the_ladder_equal_a_full_ranking(spark, distinct):
    rng = random.Random(distinct)
    rows = [(k, rng.randrange(2), rng.randrange(distinct) / distinct) for k in range(997)]
    df = spark.createDataFrame(rows, SCORED)
    ranked = ranking.ascending_rank(df).withColumn("g", ranking.risk_group_of(10))
    wanted = {r.g: (r.n, r.pos) for r in ranked.groupBy("g").agg(F.count("*").alias("n"), F.sum("target").alias("pos")).collect()}
    found = {r.risk_group: (r.cases, r.observed) for r in calibration.risk_group_table(df).collect()}
    assert found == wanted
    lift = {r.decile: (r.records, r.untimely) for r in ranking.decile_lift(df).collect()}
    falling = sorted(rows, key=lambda r: (-r[2], r[0]))
    tenth = len(rows) // 10
    deciles = [falling[i * tenth : (i + 1) * tenth if i < 9 else None] for i in range(10)]
    assert lift == {i + 1: (len(d), sum(r[1] for r in d)) for i, d in enumerate(deciles)}
