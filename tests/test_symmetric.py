"""Boosted symmetric trees against a plain fit, row by row."""

import hashlib
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from duewatch.config import StudyConfig
from duewatch.operators import symmetric
from test_models import sample_rows

CFG = StudyConfig(categorical=("product", "company"), tree_count=23, tree_depth=3)
SCHEMA = "complaint_id long, product string, company string, year int, month int, quarter int, target int"
GRID = [k / 20 for k in range(2, 16)]
BORDERS = {
    "product_rate": GRID, "company_rate": GRID, "year_num": [2020.0, 2021.0, 2022.0],
    "month_num": [float(k) for k in range(1, 12)], "quarter_num": [1.0, 2.0, 3.0],
}


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(sample_rows(500), SCHEMA)


def plain_rates(rows):
    """Ordered rates by walking over the rows in their drawn order."""
    prior = sum(r[6] for r in rows) / len(rows)
    seen, rates = {}, {}
    for row in sorted(rows, key=lambda r: hashlib.md5(f"order-{CFG.seed}-{r[0]}".encode()).hexdigest()):
        rates[row[0]] = []
        for column, level in (("product", row[1] or "MISSING"), ("company", row[2])):
            n, pos = seen.get((column, level), (0, 0))
            rates[row[0]].append((pos + prior) / (n + 1))
            seen[column, level] = n + 1, pos + row[6]
    return prior, seen, rates


def plain_fit(rows):
    """Every split tried on the rows themselves; values and margins without bins or whole-number sums."""
    prior, _, rates = plain_rates(rows)
    x = np.array([[*rates[r[0]], r[3], r[4], r[5]] for r in rows], float)
    y = np.array([r[6] for r in rows], float)
    margin = np.full(len(y), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    trees = []
    for _ in range(CFG.tree_count):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaf, splits = np.zeros(len(y), int), []
        own = lambda leaf: sum(
            g[leaf == k].sum() ** 2 / (h[leaf == k].sum() + 3.0) for k in np.unique(leaf)
        )
        for level in range(CFG.tree_depth):
            best = None
            for k, (name, borders) in enumerate(BORDERS.items()):
                for border in borders:
                    gain = own(leaf | ((x[:, k] > border).astype(int) << level)) - own(leaf)
                    if best is None or gain > best[0] + 1e-6:
                        best = gain, name, border, k
            splits.append((best[1], best[2], best[0]))
            leaf |= (x[:, best[3]] > best[2]).astype(int) << level
        values = [-0.1 * g[leaf == k].sum() / (h[leaf == k].sum() + 3.0) for k in range(1 << CFG.tree_depth)]
        margin += np.array(values)[leaf]
        trees.append((splits, values))
    return trees


def test_ordered_rates(train):
    rows = sample_rows(500)
    prior, _, expected = plain_rates(rows)
    got = symmetric.ordered_rates(symmetric.in_drawn_order(train, CFG), CFG.categorical, prior)
    ids = symmetric.in_drawn_order(train, CFG).select("rank", "complaint_id")
    for row in got.join(ids, "rank").collect():
        assert row.rate == pytest.approx(expected[row.complaint_id][CFG.categorical.index(row.feature)], abs=1e-12)


def test_rates_carry_over_bands(train, monkeypatch):
    whole = dict(((r.rank, r.feature), r.rate) for r in _rates(train))
    monkeypatch.setattr(symmetric, "BAND_BITS", 3)
    assert dict(((r.rank, r.feature), r.rate) for r in _rates(train)) == whole


def _rates(train):
    return symmetric.ordered_rates(symmetric.in_drawn_order(train, CFG), CFG.categorical, 0.25).collect()


@pytest.fixture(scope="module")
def fitted(train):
    return symmetric.train_symmetric(train, CFG, BORDERS)


def test_fit_equals_a_plain_one(fitted):
    """More trees than one writing of the margins covers."""
    assert CFG.tree_count > symmetric.TREES_PER_WRITE
    for tree, (splits, values) in zip(fitted.trees, plain_fit(sample_rows(500)), strict=True):
        assert [s for s in tree.splits] == [(name, border) for name, border, _ in splits]
        assert tree.gains == pytest.approx([gain for *_, gain in splits], abs=1e-4)
        assert tree.values == pytest.approx(values, abs=1e-6)


def test_fit_does_not_depend_on_partitions_or_order(train, fitted):
    other = symmetric.train_symmetric(train.orderBy(F.desc("month")).repartition(7), CFG, BORDERS)
    assert other.trees == fitted.trees


def test_score_store_and_nodes(spark, train, fitted, tmp_path):
    path = str(tmp_path / "symmetric")
    fitted.save(path)
    loaded = symmetric.SymmetricTrees.load(spark, path, CFG)
    assert loaded.trees == fitted.trees
    unseen = train.withColumn("company", F.when(F.col("complaint_id") % 3 > 0, F.col("company")).otherwise(F.lit("new")))
    unseen = unseen.withColumn("month", F.when(F.col("complaint_id") % 5 > 0, F.col("month")))
    scores = dict(map(tuple, fitted.score(unseen, "complaint_id").collect()))
    assert len(scores) == 500 and dict(map(tuple, loaded.score(unseen, "complaint_id").collect())) == scores
    nodes = loaded.forest().score(loaded.with_features(unseen), "complaint_id")
    assert dict(map(tuple, nodes.collect())) == pytest.approx(scores, abs=1e-6)
    prior, seen, _ = plain_rates(sample_rows(500))
    for row in unseen.collect():
        rate = lambda c, level: (seen[c, level][1] + prior) / (seen[c, level][0] + 1) if (c, level) in seen else prior
        x = {"product_rate": rate("product", row.product or "MISSING"), "company_rate": rate("company", row.company),
             "year_num": row.year, "month_num": -math.inf if row.month is None else row.month, "quarter_num": row.quarter}
        margin = fitted.start + sum(
            t.values[sum((x[f] > b) << k for k, (f, b) in enumerate(t.splits))] for t in fitted.trees
        )
        assert scores[row.complaint_id] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)
    assert sum(r.importance for r in fitted.importance().collect()) == pytest.approx(100)


def test_borders_from_quantiles_learn_something(train):
    model = symmetric.train_symmetric(train, CFG)
    late = {r.target: r.score for r in model.score(train, "target").groupBy("target").agg(F.avg("score").alias("score")).collect()}
    assert late[1] > late[0] + 0.05


def test_one_class_repeated_rows_and_empty(train):
    short = replace(CFG, tree_count=2)
    late = train.where("target = 1").limit(40)
    model = symmetric.train_symmetric(late.unionAll(late), short, BORDERS)
    assert min(r.score for r in model.score(late).collect()) > 0.9
    same = train.withColumns({c: F.lit("x") for c in CFG.categorical} | {n: F.lit(1) for n in CFG.numeric})
    stumps = symmetric.train_symmetric(same, short, dict.fromkeys(BORDERS, []))
    assert [t.splits for t in stumps.trees] == [(), ()]
    assert len({r.score for r in stumps.score(train).collect()}) == 1
    with pytest.raises(ValueError, match="empty"):
        symmetric.train_symmetric(train.limit(0), short, BORDERS)


def test_levels_by_job_give_the_same_trees_in_few_short_jobs(spark, train, fitted):
    """Rows of one task need no job for each level; rows of several tasks give the same trees by jobs."""
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("symmetric-fit"))
    spark.sparkContext.setJobGroup("symmetric-fit", "")
    try:
        assert symmetric.train_symmetric(train, CFG, BORDERS).trees == fitted.trees
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs() < CFG.tree_count
    assert symmetric.train_symmetric(train, replace(CFG, fit_rows_per_task=100), BORDERS).trees == fitted.trees


def test_scores_plan_does_not_grow_with_the_trees(train, fitted):
    """One lookup a tree as an expression took a minute to compile for 500 trees."""
    many = replace(fitted, trees=fitted.trees * 20)
    plan = lambda model: len(model.score(train, "complaint_id")._jdf.queryExecution().optimizedPlan().toString())
    assert plan(many) < 1.5 * plan(fitted)
