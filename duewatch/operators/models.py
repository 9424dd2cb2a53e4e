"""Fitting with MLlib on the sample; scoring of whole populations as plain joins and arithmetic.

A fitted logistic model is a table of level weights plus a few numbers, so a population is scored
inside one generated stage without building vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import StudyConfig
from ..functions import fill_missing_levels
from ..session import fit_tasks, stage
from . import boosting, newton
from .encoding import Encoder, fit_scaling, join_levels, scaled, stack_categories
from .forest import Forest
from .metrics import evaluate

DIRECTIONS = ("increases untimely risk", "decreases untimely risk")


def model_exists(spark: SparkSession, path: str) -> bool:
    """Whether a model was stored; a step skips a model that is missing."""
    try:
        spark.read.parquet(f"{path}/numbers").schema
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def fit_on(estimator, vectors: DataFrame, rows: int, cfg: StudyConfig, rows_per_task: int | None = None):
    """Fit on cached vectors. The cache lives on the executors; lost blocks are computed again.

    A task gets at least ``rows_per_task`` rows (default: ``fit_rows_per_task``), enough to outweigh launching it every
    iteration.
    """
    tasks = fit_tasks(vectors.sparkSession, rows, rows_per_task or cfg.fit_rows_per_task)
    cached = vectors.repartition(tasks).persist()
    try:
        return estimator.fit(cached)
    finally:
        cached.unpersist()


def fit_logistic(
    vectors: DataFrame, rows: int, cfg: StudyConfig, rows_per_task: int | None = None
) -> LogisticRegressionModel:
    """L2 logistic regression whose objective is ``C * sum(loss) + |w|^2 / 2``, intercept free."""
    estimator = LogisticRegression(
        featuresCol="features",
        labelCol="target",
        regParam=1.0 / (cfg.logistic_c * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=cfg.logistic_iterations,
    )
    return fit_on(estimator, vectors, rows, cfg, rows_per_task)


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


# --------------------------------------------------------------------------- structured logistic


@dataclass(frozen=True)
class LinearModel:
    """Level weights ``(feature, level, weight)`` and numeric terms of a logistic model."""

    columns: tuple[str, ...]
    weights: DataFrame
    numbers: dict[str, tuple[float, float, float]]  # feature -> (mean, std, weight)
    intercept: float
    coefficients: DataFrame

    def total(self, weight: Callable[[str], Column], renamed: dict[str, str] | None = None) -> Column:
        """The margin of a row, given the weight of its level per category."""
        terms = [F.coalesce(weight(c), F.lit(0.0)) for c in self.columns]
        for name, (mean, std, w) in self.numbers.items():
            terms.append(F.lit(w) * scaled((renamed or {}).get(name, name), mean, std))
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def margin(self, df: DataFrame) -> DataFrame:
        filled = fill_missing_levels(df, self.columns)
        joined = join_levels(filled, self.weights, self.columns, "weight", "_weight")
        total = self.total(lambda c: F.col(f"{c}_weight"))
        return joined.withColumn("margin", total).drop(*[f"{c}_weight" for c in self.columns])

    def score(self, df: DataFrame, *keep: str) -> DataFrame:
        """P(late) as float for every row, rows with unseen levels included."""
        return self.margin(df).select(*keep, sigmoid(F.col("margin")).cast("float").alias("score"))

    def save(self, path: str) -> None:
        spark = self.weights.sparkSession
        self.weights.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/weights")
        self.coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
        rows = [(n, *v) for n, v in self.numbers.items()] + [("(intercept)", 0.0, 1.0, self.intercept)]
        spark.createDataFrame(rows, "feature string, mean double, std double, weight double").write.mode(
            "overwrite"
        ).parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str, cfg: StudyConfig) -> LinearModel:
        rows = {r.feature: r for r in spark.read.parquet(f"{path}/numbers").collect()}
        intercept = rows.pop("(intercept)").weight
        return cls(
            tuple(cfg.categorical),
            spark.read.parquet(f"{path}/weights"),
            {n: (rows[n]["mean"], rows[n]["std"], rows[n].weight) for n in cfg.numeric if n in rows},
            intercept,
            spark.read.parquet(f"{path}/coefficients"),
        )


def train_logreg(
    train: DataFrame,
    cfg: StudyConfig,
    encoder: Encoder | None = None,
    numeric: Sequence[str] | None = None,
) -> LinearModel:
    """Fit on the sample. A given encoder keeps its levels; the scaling is always refitted."""
    numeric = tuple(cfg.numeric if numeric is None else numeric)
    if encoder is None:
        encoder = Encoder.fit(train, cfg)
        scaling = {n: encoder.scaling[n] for n in numeric}
    else:
        scaling = fit_scaling(train, numeric)
    vectors = encoder.transform(train, scaling).select("target", "features")
    fitted = fit_logistic(vectors, train.count(), cfg)

    values = fitted.coefficients.toArray()
    return _linear(encoder, {n: scaling[n] for n in numeric}, values, float(fitted.intercept))


def _linear(
    encoder: Encoder, scaling: dict[str, tuple[float, float]], values: np.ndarray, intercept: float
) -> LinearModel:
    """The model of a weight per encoded column, those of the scaled numbers last."""
    spark = encoder.levels.sparkSession
    by_position = spark.createDataFrame(
        pd.DataFrame({"position": range(len(values)), "coefficient": values}), "position bigint, coefficient double"
    )
    weights = stage(
        encoder.levels.join(by_position, "position").select("feature", "level", F.col("coefficient").alias("weight")),
        "weights",
        partition_by=("feature",),
    )
    named = encoder.names(list(scaling)).join(by_position, "position").select("feature", "coefficient")
    numbers = {n: (*scaling[n], float(w)) for n, w in zip(scaling, values[encoder.width :])}
    return LinearModel(encoder.columns, weights, numbers, intercept, named)


def train_exact(
    train: DataFrame, cfg: StudyConfig, variants: Sequence[str] = ("baseline",), encoder: Encoder | None = None
) -> dict[str, LinearModel]:
    """The logistic model of each variant of the year, to the last digits, all from the same scans.

    ``baseline`` has the year, ``dropped`` has not, ``capped`` has the year up to the last one of training.
    """
    encoder = encoder or Encoder.fit(train, cfg)
    rows = train.withColumn("_capped", F.least("year", F.lit(cfg.last_train_year)))
    fitted = fit_scaling(rows, [*cfg.numeric, "_capped"])
    columns = {
        v: {n: "_capped" if (v, n) == ("capped", "year") else n for n in cfg.numeric if (v, n) != ("dropped", "year")}
        for v in variants
    }
    solutions = newton.fit(
        rows, encoder, {c: (c, *fitted[c]) for c in fitted}, [list(columns[v].values()) for v in variants],
        cfg.logistic_c, cfg.fit_rows_per_task,
    )
    return {
        v: _linear(
            encoder,
            {n: fitted[c] for n, c in columns[v].items()},
            np.concatenate([solution.weights, [solution.numbers[c] for c in columns[v].values()]]),
            solution.intercept,
        )
        for v, solution in zip(variants, solutions)
    }


def logreg_coefficients(model: LinearModel) -> DataFrame:
    """Encoded columns by the size of their coefficient, with its direction."""
    value = F.col("coefficient")
    return model.coefficients.select(
        "feature",
        "coefficient",
        F.abs(value).alias("abs_coef"),
        F.when(value > 0, F.lit(DIRECTIONS[0])).otherwise(F.lit(DIRECTIONS[1])).alias("direction"),
    ).orderBy(F.desc("abs_coef"), F.asc("feature"))


# --------------------------------------------------------------------------- boosted trees

FOLDS = 5


def target_encoding(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smoothed late rate per level: over all rows (fold -1) and, per fold, over the other folds.

    Training rows use the rate of the folds they are not in, so a row never sees its own label.
    """
    filled = fill_missing_levels(train, columns).withColumn("fold", _fold())
    prior = train.agg(F.avg("target")).scalar()
    cells = stack_categories(filled, columns, "fold", "target")
    within = lambda fold: F.when(F.col("fold") == fold, F.col("target"))
    per_level = cells.groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("target").alias("pos"),
        *(F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)),
        *(F.coalesce(F.sum(within(f)), F.lit(0)).alias(f"pos{f}") for f in range(FOLDS)),
    )
    own = {-1: (F.lit(0), F.lit(0))} | {f: (F.col(f"n{f}"), F.col(f"pos{f}")) for f in range(FOLDS)}
    rates = [
        F.struct(F.lit(f).alias("fold"), ((F.col("pos") - pos + prior) / (F.col("n") - n + 1)).alias("rate"))
        for f, (n, pos) in own.items()
    ]
    return per_level.select("feature", "level", F.inline(F.array(*rates)))


def _fold() -> Column:
    """By the first hex digits of the id's digest."""
    digits = F.substring(F.md5(F.coalesce(F.col("complaint_id").cast("string"), F.lit(""))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(FOLDS)).cast("int")


@dataclass(frozen=True)
class TreeModel:
    """Boosted trees over target-encoded categories and raw calendar numbers; ``forest`` is the table of the same trees."""

    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    rates: DataFrame
    prior: float
    trees: GBTClassificationModel
    forest: Forest

    def score(self, df: DataFrame, *keep: str) -> DataFrame:
        """P(late) as float for every row, as ``trees`` have it, with rows looked up in blocks."""
        ready, inputs = _tree_inputs(
            df.withColumn("fold", F.lit(-1)), self.rates, self.prior, self.columns, self.numeric
        )
        found = boosting.margin_of(self.forest, ready, inputs, *keep)
        return found.select(*found.columns[:-1], sigmoid(2.0 * F.col("_margin")).cast("float").alias("score"))

    def importance(self) -> DataFrame:
        """Share of the total split gain per feature, in percent."""
        spark = self.rates.sparkSession
        names = (*self.columns, *self.numeric)
        rows = [(n, 100.0 * float(v)) for n, v in zip(names, self.trees.featureImportances.toArray())]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), F.asc("feature")
        )

    def save(self, path: str) -> None:
        self.rates.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/rates")
        self.trees.write().overwrite().save(f"{path}/trees")
        self.rates.sparkSession.createDataFrame([(self.prior,)], "prior double").write.mode(
            "overwrite"
        ).parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str, cfg: StudyConfig) -> TreeModel:
        columns, numeric = tuple(cfg.categorical), tuple(cfg.numeric)
        prior = spark.read.parquet(f"{path}/numbers").first().prior
        return cls(columns, numeric, spark.read.parquet(f"{path}/rates"), prior, *_stored_trees(spark, f"{path}/trees", columns, numeric))


def _stored_trees(spark, path, columns, numeric) -> tuple[GBTClassificationModel, Forest]:
    names = [f"{c}_rate" for c in columns] + [f"{n}_num" for n in numeric]
    return GBTClassificationModel.load(path), Forest.of_stored_trees(spark, path, names)


def _tree_inputs(df, rates, prior, columns, numeric) -> tuple[DataFrame, list[str]]:
    filled = fill_missing_levels(df, columns)
    joined = join_levels(filled, rates, columns, "rate", "_rate", "fold")
    inputs = {f"{c}_rate": F.coalesce(F.col(f"{c}_rate"), F.lit(prior)) for c in columns}
    inputs |= {f"{n}_num": F.col(n).cast("double") for n in numeric}
    return joined.withColumns(inputs), list(inputs)


def _tree_features(df, rates, prior, columns, numeric) -> DataFrame:
    ready, inputs = _tree_inputs(df, rates, prior, columns, numeric)
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(ready)


def train_gbt(train: DataFrame, cfg: StudyConfig) -> TreeModel:
    columns, numeric = tuple(cfg.categorical), tuple(cfg.numeric)
    rates = stage(target_encoding(train, columns), "rates", partition_by=("feature",))
    prior = train.agg(F.avg("target")).first()[0]
    ready, inputs = _tree_inputs(train.withColumn("fold", _fold()), rates, prior, columns, numeric)
    estimator = GBTClassifier(
        featuresCol="features",
        labelCol="target",
        maxIter=cfg.tree_count,
        maxDepth=cfg.tree_depth,
        stepSize=cfg.tree_step,
        seed=cfg.seed,
    )
    features = stage(ready.select("target", *inputs), "tree-features")
    path = boosting.train(features, estimator, cfg.fit_rows_per_task)
    return TreeModel(columns, numeric, rates, prior, *_stored_trees(train.sparkSession, path, columns, numeric))


# --------------------------------------------------------------------------- year ablation

VARIANTS = ("baseline", "dropped", "capped")


def year_ablation(
    train: DataFrame, evaluated: DataFrame, cfg: StudyConfig, variants: Sequence[str] = VARIANTS
) -> DataFrame:
    """Fits with the year kept, dropped and capped on one encoder, side by side; metrics per variant and period.

    The evaluated rows are scored by all variants in one pass: one weight table with a column per
    variant, one join per category.
    """
    encoder = Encoder.fit(train, cfg)
    weights, fitted = encoder.levels.select("feature", "level"), train_exact(train, cfg, variants, encoder)
    for variant, model in fitted.items():
        own = model.weights.select("feature", "level", F.col("weight").alias(variant))
        weights = weights.join(own, ["feature", "level"])
    weights = weights.select("feature", "level", F.struct(*variants).alias("weights"))
    weights = stage(weights, "variant-weights", partition_by=("feature",))

    rows = evaluated.select("*", F.col("year").alias("period"), F.least("year", F.lit(cfg.last_train_year)).alias("_capped"))
    joined = join_levels(fill_missing_levels(rows, encoder.columns), weights, encoder.columns, "weights", "_weights")
    scores = []
    for variant, model in fitted.items():
        total = model.total(
            lambda c, v=variant: F.col(f"{c}_weights")[v], {"year": "_capped"} if variant == "capped" else None
        )
        scores.append(F.struct(F.lit(variant).alias("variant"), sigmoid(total).cast("float").alias("score")))
    scored = joined.select("period", "target", F.inline(F.array(*scores)))
    return evaluate(scored, cfg.decision_threshold, ["variant", "period"]).select(
        "variant", "period", "recall", "precision", "flagged", "pr_auc", "roc_auc", "mean_score"
    )


def ablation_shift(ablation: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Fall in recall and shift of the mean score from validation to test, per variant."""
    at = lambda column, year: F.max(F.when(F.col("period") == year, F.col(column)))
    early, late = cfg.validation_year, cfg.test_year
    return ablation.groupBy("variant").agg(
        at("recall", early).alias("recall_validation"),
        at("recall", late).alias("recall_test"),
        (at("recall", early) - at("recall", late)).alias("recall_fall"),
        (at("mean_score", late) - at("mean_score", early)).alias("mean_score_shift"),
    )
