"""Boosted trees from packed rows against MLlib's own fit of the same vectors."""

import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duewatch.config import StudyConfig
from duewatch.operators import boosting, models
from test_models import sample_rows

CFG = StudyConfig(categorical=("product", "company"), numeric=("year", "month"), tree_count=12, tree_depth=4)
SCHEMA = "complaint_id long, product string, company string, year int, month int, quarter int, target int"


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(sample_rows(3000), SCHEMA).cache()


@pytest.fixture(scope="module")
def fitted(train):
    return models.train_gbt(train, CFG)


@pytest.fixture(scope="module")
def mllib(train, fitted):
    """What MLlib fits, with the vectors that it was given."""
    rows = train.withColumn("fold", models._fold())
    vectors = models._tree_features(rows, fitted.rates, fitted.prior, fitted.columns, fitted.numeric).cache()
    how = {"maxIter": CFG.tree_count, "maxDepth": CFG.tree_depth, "stepSize": CFG.tree_step, "seed": CFG.seed}
    return GBTClassifier(featuresCol="features", labelCol="target", **how).fit(vectors), vectors


def chances(model, vectors):
    chance = vector_to_array("probability")[1]
    return {r.complaint_id: r.chance for r in model.transform(vectors).select("complaint_id", chance.alias("chance")).collect()}


def shape(model):
    return [tree.toDebugString.split("\n", 1)[1] for tree in model.trees.trees]


def test_trees_are_those_of_mllib(fitted, mllib):
    theirs, vectors = mllib
    ours = fitted.trees
    assert ours.treeWeights == theirs.treeWeights and ours.numFeatures == theirs.numFeatures
    assert ours.trees[0].toDebugString.split("\n", 1)[1] == theirs.trees[0].toDebugString.split("\n", 1)[1]
    # Where two splits part the same few rows, rounding decides in MLlib; the rows' chances are the same.
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-3)
    assert chances(ours, vectors) == pytest.approx(chances(theirs, vectors), abs=1e-7)


def test_stored_nodes_are_complete(spark, fitted, mllib, tmp_path):
    """Counts, sums, squares and impurities of the nodes, which MLlib stores with the splits."""
    theirs = mllib[0]
    for name, model in (("ours", fitted.trees), ("theirs", theirs)):
        model.save(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name / "data")).where("treeID = 0").orderBy("nodeData.id").collect()
    for a, b in zip(read("ours"), read("theirs"), strict=True):
        for field in ("id", "rawCount", "leftChild", "rightChild"):
            assert a.nodeData[field] == b.nodeData[field]
        for field in ("prediction", "impurity", "gain", "impurityStats"):
            assert a.nodeData[field] == pytest.approx(b.nodeData[field], abs=1e-9)
        assert a.nodeData.split == b.nodeData.split


def test_a_fit_takes_few_jobs(spark, train):
    """MLlib started some for every tree."""
    spark.sparkContext.setJobGroup("boosted-fit", "")
    try:
        models.train_gbt(train, replace(CFG, tree_count=60))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted-fit")) < 60


def test_rows_of_many_tasks_give_the_same_trees(train, fitted, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_HERE", 100)
    spread = models.train_gbt(train.repartition(5), replace(CFG, fit_rows_per_task=500))
    assert shape(spread) == shape(fitted)
    assert spread.trees.featureImportances == fitted.trees.featureImportances


@pytest.mark.parametrize("loads", [20, 1])
def test_rows_that_an_executor_lost_are_written_again(train, fitted, monkeypatch, loads):
    """After some trees the files of a task are gone; if that goes on, one task ends the fit."""
    monkeypatch.setattr(boosting, "ROWS_HERE", 100)
    monkeypatch.setattr(boosting, "MOST_LOADS", loads)
    whole, calls = boosting.Spread.sums, []

    def lossy(self, levels, slots):
        calls.append(len(levels))
        if len(calls) in (2, 9, 21):  # a level within the first tree, roots and levels of later ones
            path = self.handles.mapPartitionsWithIndex(
                lambda task, _, fit=f"{self.fit}-{self.loads}": [boosting.Kept(fit, task).path]
            ).collect()[1]
            shutil.rmtree(path)
        return whole(self, levels, slots)

    monkeypatch.setattr(boosting.Spread, "sums", lossy)
    cfg = replace(CFG, fit_rows_per_task=500)
    if loads == 1:
        with pytest.warns(UserWarning, match="goes on in one task"):
            lost = models.train_gbt(train, cfg)
    else:
        lost = models.train_gbt(train, cfg)
    assert shape(lost) == shape(fitted)


def test_files_of_a_fit_are_removed(train, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_HERE", 100)
    seen, closed = [], boosting.Spread.close

    def close(self):
        paths = lambda: self.handles.mapPartitionsWithIndex(
            lambda task, _, fit=f"{self.fit}-{self.loads}": [__import__("os").path.exists(boosting.Kept(fit, task).path)]
        ).collect()
        seen.append(paths())
        fit = f"{self.fit}-{self.loads}"
        closed(self)
        context = train.sparkSession.sparkContext
        left = context.parallelize(range(6), 6).map(lambda task: __import__("os").path.exists(boosting.Kept(fit, task).path))
        seen.append(left.collect())

    monkeypatch.setattr(boosting.Spread, "close", close)
    models.train_gbt(train, replace(CFG, tree_count=2, fit_rows_per_task=500))
    assert all(seen[0]) and not any(seen[1])


def test_scores_are_those_of_the_stored_trees(train, fitted):
    unseen = train.withColumn("company", F.when(F.col("complaint_id") % 3 > 0, F.col("company")).otherwise(F.lit("new")))
    rows = unseen.withColumn("fold", F.lit(-1))
    vectors = models._tree_features(rows, fitted.rates, fitted.prior, fitted.columns, fitted.numeric)
    scored = {r.complaint_id: r.score for r in fitted.score(unseen, "complaint_id", F.col("year").alias("period")).collect()}
    assert scored == pytest.approx(chances(fitted.trees, vectors), abs=1e-6) and len(scored) == 3000


def test_borders_by_mllibs_rule():
    assert boosting.borders_of(iter([(1.0, 5), (2.0, 1), (4.0, 9)]), 15, 2) == [1.5, 3.0]
    assert boosting.borders_of(iter([(1.0, 5)]), 5, 31) == []
    # Shares of 4 rows each: 4 rows are below 1.5 and 8 below 3.5.
    assert boosting.borders_of(iter([(1.0, 4), (2.0, 2), (3.0, 2), (4.0, 4)]), 12, 2) == [1.5, 3.5]


def test_borders_count_all_rows(spark):
    """MLlib looked at ten thousand of them."""
    rows = spark.range(40_000).select((F.col("id") % 2).alias("target"), F.col("id").cast("double").alias("x"))
    (borders,) = boosting.candidate_borders(rows, 40_000, 32)
    assert borders == [1250.0 * k - 0.5 for k in range(1, 32)]


def test_features_are_counted_together_within_a_bound():
    widths = [32, 4, 25, 12, 300]
    groups = boosting.together(widths, 2048)
    assert sorted(sum(groups, [])) == list(range(5))
    assert all(np.prod([widths[k] for k in group]) <= 2048 for group in groups) and len(groups) < 5


def test_one_class_missing_numbers_and_empty(spark, train):
    short = replace(CFG, tree_count=2)
    late = models.train_gbt(train.where("target = 1"), short)
    assert late.trees.totalNumNodes == 2 and min(r.score for r in late.score(train).collect()) > 0.8
    with pytest.raises(ValueError, match="empty"):
        models.train_gbt(train.limit(0), short)
    for broken in (F.when(F.col("complaint_id") > 5, F.col("month")), F.lit(float("nan"))):
        with pytest.raises(Exception, match="missing values in month_num"):
            models.train_gbt(train.withColumn("month", broken), short)


def test_rates_are_counted_in_one_aggregate(train):
    """Counts by fold went through a second aggregate that collected them into maps."""
    plan = models.target_encoding(train, CFG.categorical)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert plan.count("Aggregate [feature") == 1
