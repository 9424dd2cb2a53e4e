"""Threshold metrics and exact ranking metrics. Every function takes rows and groups by ``by``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import StudyConfig
from ..functions import passes, row_count, safe_ratio
from .ranking import known_score, score_ladder


# Report column order of a model comparison.
COMPARISON_COLUMNS = (
    "model", "accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc", "untimely_identified",
    "untimely_total", "no_skill_pr_auc", "positive_prevalence", "n", "n_positive", "threshold",
    "tp", "fp", "tn", "fn", "flagged", "flag_rate", "reviews_per_catch",
)


# --------------------------------------------------------------------------- thresholds


def metrics_at_thresholds(
    scored: DataFrame,
    thresholds: Sequence[float],
    by: Sequence[str] = (),
    score: str = "score",
    target: str = "target",
) -> DataFrame:
    """Confusion counts and derived rates at every threshold, in one pass over the rows.

    Rows are first counted by how many thresholds they pass, so the pass keeps a handful of counts
    per group and the thresholds never multiply the rows.
    """
    cuts = sorted(thresholds)
    scored = scored.withColumn(score, known_score(F.col(score)))
    passed = reduce(lambda a, b: a + b, [passes(scored, score, t).cast("int") for t in cuts])
    levels = scored.groupBy(*by, passed.alias("passed")).agg(
        row_count().alias("n"), F.sum(target).cast("bigint").alias("pos")
    )
    cut = F.explode(
        F.array(*[F.struct(F.lit(i + 1).alias("need"), F.lit(float(t)).alias("threshold"))
                  for i, t in enumerate(cuts)])
    )
    flagged = F.col("passed") >= F.col("cut.need")
    counts = (
        levels.select("*", cut.alias("cut"))
        .groupBy(*by, F.col("cut.threshold").alias("threshold"))
        .agg(
            _total(F.when(flagged, F.col("pos"))).alias("tp"),
            _total(F.when(flagged, F.col("n") - F.col("pos"))).alias("fp"),
            _total(F.when(~flagged, F.col("n") - F.col("pos"))).alias("tn"),
            _total(F.when(~flagged, F.col("pos"))).alias("fn"),
        )
    )
    return _with_rates(counts, by)


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def _with_rates(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return counts.select(
        *by,
        "threshold",
        F.coalesce(safe_ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(safe_ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(safe_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        safe_ratio(tp + tn, n).alias("accuracy"),
        "tp",
        "fp",
        "tn",
        "fn",
        (tp + fp).alias("flagged"),
        safe_ratio(tp + fp, n).alias("flag_rate"),
        safe_ratio(tp + fp, tp).alias("reviews_per_catch"),
    )


def metrics_at_threshold(
    scored: DataFrame, threshold: float, by: Sequence[str] = (), score: str = "score"
) -> DataFrame:
    return metrics_at_thresholds(scored, [threshold], by, score)


def confusion_counts(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return metrics_at_threshold(scored, threshold, score=score).select(
        "threshold", "tn", "fp", "fn", "tp"
    )


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """The two-by-two layout of one row of counts."""
    cell = lambda label, timely, untimely: F.struct(
        F.lit(label).alias("actual"),
        F.col(timely).alias("predicted_timely"),
        F.col(untimely).alias("predicted_untimely"),
    )
    return counts.select(
        F.inline(
            F.array(cell("Actually timely", "tn", "fp"), cell("Actually untimely", "fn", "tp"))
        )
    )


def threshold_sweep(scored: DataFrame, cfg: StudyConfig, score: str = "score") -> DataFrame:
    return metrics_at_thresholds(scored, cfg.sweep, score=score).orderBy("threshold")


def locked_threshold_summary(sweep: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The sweep row at the decision threshold, in the terms of the decision."""
    return sweep.where(F.col("threshold") == F.lit(cfg.decision_threshold)).select(
        "threshold",
        "flagged",
        (100 * F.col("flag_rate")).alias("flagged_pct"),
        F.col("tp").alias("caught"),
        (F.col("tp") + F.col("fn")).alias("untimely_total"),
        "reviews_per_catch",
    )


def threshold_explorer(sweep: DataFrame) -> DataFrame:
    """Per threshold: caught, missed, workload, and late cases per hundred opened."""
    hits = F.floor(100 * F.col("precision") + 0.5).cast("int")
    return sweep.select(
        "threshold",
        F.col("tp").alias("caught"),
        F.col("fn").alias("missed"),
        safe_ratio(100 * F.col("fn"), F.col("tp") + F.col("fn")).alias("missed_pct"),
        "flagged",
        "flag_rate",
        "reviews_per_catch",
        hits.alias("hits_per_100"),
        (100 - hits).alias("rest_per_100"),
    )


# --------------------------------------------------------------------------- ranking


def ranking_metrics(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", target: str = "target"
) -> DataFrame:
    """Exact average precision and ROC area with prevalence and counts, from one score ladder."""
    return ladder_metrics(score_ladder(scored, by, score, target), by)


def ladder_metrics(ladder: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _ranking_columns(ladder.groupBy(*by).agg(*_ranking_sums()), by)


def _ranking_sums() -> list[Column]:
    """Aggregates over a ladder that ranking metrics derive from."""
    pos, n = F.col("pos"), F.col("n")
    precision = safe_ratio(F.col("pos_above") + pos, F.col("n_above") + n)
    negatives = n - pos
    neg_total = F.col("n_total") - F.col("pos_total")
    neg_below = neg_total - (F.col("n_above") - F.col("pos_above")) - negatives
    concordant = pos * (neg_below.cast("double") + negatives.cast("double") / 2)
    return [
        F.sum(pos * precision).alias("ap"),
        F.sum(concordant).alias("wins"),
        F.max("n_total").alias("n"),
        F.max("pos_total").alias("n_positive"),
    ]


def _ranking_columns(sums: DataFrame, by: Sequence[str], *also: str) -> DataFrame:
    positives = F.col("n_positive").cast("double")
    prevalence = safe_ratio(F.col("n_positive"), F.col("n"))
    return sums.select(
        *by,
        F.try_divide("ap", positives).alias("pr_auc"),
        F.try_divide("wins", positives * (F.col("n") - F.col("n_positive"))).alias("roc_auc"),
        prevalence.alias("no_skill_pr_auc"),
        prevalence.alias("positive_prevalence"),
        "n",
        "n_positive",
        *also,
    )


def evaluate(
    scored: DataFrame,
    threshold: float,
    by: Sequence[str] = (),
    score: str = "score",
    cut: Column | None = None,
) -> DataFrame:
    """Ranking metrics, metrics at one threshold and the mean score, all from one score ladder.

    ``cut`` overrides the compared value, for groups whose scores differ in precision.
    """
    if cut is None:
        cut = F.lit(threshold).cast(scored.schema[score].dataType)
    flagged = F.col("score") >= cut
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    sums = (
        score_ladder(scored, by, score)
        .groupBy(*by)
        .agg(
            *_ranking_sums(),
            _total(F.when(flagged, pos)).alias("tp"),
            _total(F.when(flagged, neg)).alias("fp"),
            _total(F.when(~flagged, neg)).alias("tn"),
            _total(F.when(~flagged, pos)).alias("fn"),
            (F.sum(F.col("score").cast("double") * F.col("n")) / F.sum("n")).alias("mean_score"),
            F.lit(float(threshold)).alias("threshold"),
        )
    )
    ranked = _ranking_columns(sums, by, "mean_score", "threshold", "tp", "fp", "tn", "fn")
    return _with_rates(ranked, [c for c in ranked.columns if c not in _RATE_INPUTS])


_RATE_INPUTS = ("threshold", "tp", "fp", "tn", "fn")


def pr_curve(ladder: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, and the end point (recall 0, precision 1)."""
    caught = F.col("pos_above") + F.col("pos")
    points = ladder.select(
        F.col("score").cast("double").alias("threshold"),
        safe_ratio(caught, F.col("n_above") + F.col("n")).alias("precision"),
        safe_ratio(caught, F.col("pos_total")).alias("recall"),
    )
    return points.unionAll(_end_point(ladder, 1.0, 0.0))


def _end_point(ladder: DataFrame, first: float, second: float) -> DataFrame:
    return ladder.sparkSession.range(1).select(
        F.lit(None).cast("double"), F.lit(first), F.lit(second)
    )


def with_no_skill(curve: DataFrame, ladder: DataFrame) -> DataFrame:
    """The precision-recall curve of a ladder with the prevalence line beside it."""
    prevalence = safe_ratio(F.max("pos_total"), F.max("n_total"))
    return curve.withColumn("no_skill", ladder.agg(prevalence).scalar())


def roc_curve(ladder: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score, starting from (0, 0)."""
    caught = F.col("pos_above") + F.col("pos")
    alarms = F.col("n_above") + F.col("n") - caught
    points = ladder.select(
        F.col("score").cast("double").alias("threshold"),
        safe_ratio(alarms, F.col("n_total") - F.col("pos_total")).alias("fpr"),
        safe_ratio(caught, F.col("pos_total")).alias("tpr"),
    )
    return points.unionAll(_end_point(ladder, 0.0, 0.0))


def roc_corners(ladder: DataFrame) -> DataFrame:
    """The curve as published: without points whose step to the next point is the step that led to them.

    The first and the last score stay. Neighbours meet by the number of rows above them, which each score shares with
    the one before it only: no window over all scores.
    """
    columns = F.struct(*ladder.columns)
    step = F.struct("n", "pos")
    ends = F.struct((F.col("n_above") + F.col("n")).alias("at"), columns.alias("own"), F.lit(None).alias("next"))
    begins = F.struct(F.col("n_above").alias("at"), F.lit(None).alias("own"), step.alias("next"))
    met = ladder.select(F.inline(F.array(ends, begins))).groupBy("at").agg(
        F.first("own", ignorenulls=True).alias("own"), F.first("next", ignorenulls=True).alias("next")
    )
    bends = ~F.col("next").eqNullSafe(F.struct("own.n", "own.pos")) | (F.col("own.n_above") == 0)
    return roc_curve(met.where(F.col("own").isNotNull() & bends).select("own.*"))


def precision_at_recall(
    curve: DataFrame, targets: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7)
) -> DataFrame:
    """Per recall target the curve point nearest to it; ties go to the lowest threshold."""
    order = F.coalesce("threshold", F.lit(float("inf")))
    nearest = [
        F.min(
            F.struct(
                F.abs(F.col("recall") - F.lit(t)).alias("distance"),
                order.alias("threshold"),
                F.col("precision"),
                F.col("recall"),
            )
        )
        for t in targets
    ]
    row = curve.agg(*[c.alias(f"at{i}") for i, c in enumerate(nearest)])
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(t).alias("target_recall"),
                        F.col(f"at{i}.recall").alias("recall"),
                        F.col(f"at{i}.threshold").alias("threshold"),
                        F.col(f"at{i}.precision").alias("precision"),
                    )
                    for i, t in enumerate(targets)
                ]
            )
        )
    )


def roc_operating_points(
    roc: DataFrame, at_fpr: float = 0.10, at_tpr: float = 0.90
) -> DataFrame:
    """TPR at a given FPR and FPR at a given TPR, linearly interpolated on the curve."""
    bracketed = roc.agg(
        *_bracket("fpr", "tpr", at_fpr, "a"), *_bracket("tpr", "fpr", at_tpr, "b")
    )
    return bracketed.select(
        _interpolate("a", at_fpr).alias("tpr_at_fpr"),
        _interpolate("b", at_tpr).alias("fpr_at_tpr"),
    ).withColumn(
        "passed", (F.col("tpr_at_fpr") > at_tpr) & (F.col("fpr_at_tpr") < at_fpr)
    )


def _bracket(x: str, y: str, at: float, name: str) -> list[Column]:
    pair = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return [
        F.max(F.when(F.col(x) <= at, pair)).alias(f"{name}_low"),
        F.min(F.when(F.col(x) > at, pair)).alias(f"{name}_high"),
    ]


def _interpolate(name: str, at: float) -> Column:
    x0, y0 = F.col(f"{name}_low.x"), F.col(f"{name}_low.y")
    x1, y1 = F.col(f"{name}_high.x"), F.col(f"{name}_high.y")
    return F.coalesce(y0 + (y1 - y0) * F.try_divide(F.lit(at) - x0, x1 - x0), y0)


# --------------------------------------------------------------------------- comparisons


def baseline_metrics(scored: DataFrame, target: str = "target") -> DataFrame:
    """The classifier that never predicts a late response."""
    n, pos = row_count(), F.coalesce(F.sum(target), F.lit(0)).cast("bigint")
    return scored.agg(
        F.lit("majority-class baseline").alias("model"),
        safe_ratio(n - pos, n).alias("accuracy"),
        F.lit(0.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(0.0).alias("f1"),
        safe_ratio(pos, n).alias("pr_auc"),
        F.lit(0.5).alias("roc_auc"),
        F.lit(0).cast("bigint").alias("untimely_identified"),
        pos.alias("untimely_total"),
    )


def stack_scores(scored: DataFrame, models: dict[str, str], threshold: float) -> DataFrame:
    """(target, model, cut, score) rows; ``models`` maps score columns to model names."""
    return scored.select(
        "target",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("model"),
                        _own_cut(scored, column, threshold).alias("cut"),
                        F.col(column).cast("double").alias("score"),
                    )
                    for column, label in models.items()
                ]
            )
        ),
    )


def label_scores(scored: DataFrame, model: str, threshold: float) -> DataFrame:
    """The scores of one model in the layout of :func:`stack_scores`."""
    return scored.select(
        "target",
        F.lit(model).alias("model"),
        _own_cut(scored, "score", threshold).alias("cut"),
        F.col("score").cast("double").alias("score"),
    )


def _own_cut(scored: DataFrame, column: str, threshold: float) -> Column:
    """The threshold in the score's own precision, so that a float score meets a float cut."""
    return F.lit(threshold).cast(scored.schema[column].dataType).cast("double")


def evaluate_models(stacked: DataFrame, threshold: float) -> DataFrame:
    """Metrics per model of stacked scores, in one pass over the rows."""
    measured = evaluate(stacked, threshold, by=["model", "cut"], cut=F.col("cut"))
    return measured.drop("cut", "mean_score")


def model_comparison(stacked: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """The never-late baseline and every model; measures a row does not have are null."""
    rows = baseline_metrics(labels).unionByName(
        evaluate_models(stacked, threshold), allowMissingColumns=True
    )
    return rows.select(*COMPARISON_COLUMNS)


def ensemble_score(scored: DataFrame, first: str, second: str, name: str = "combined") -> DataFrame:
    """Plain mean of two scores, in double."""
    mean = (F.col(first).cast("double") + F.col(second).cast("double")) / 2.0
    return scored.withColumn(name, mean)


def narrative_model_comparison(
    scored: DataFrame, structured: str, text: str, threshold: float
) -> DataFrame:
    """Structured, text and combined scores on the text-bearing rows."""
    names = {structured: "structured (subset)", text: "tfidf text", "combined": "combined"}
    both = ensemble_score(scored, text, structured)
    return evaluate_models(stack_scores(both, names, threshold), threshold)


def final_test_summary(scored: DataFrame, cfg: StudyConfig, score: str = "score") -> DataFrame:
    """Everything about the test year in one row."""
    return evaluate(scored, cfg.decision_threshold, score=score).select(
        F.lit(cfg.test_year).alias("period"),
        F.col("n").alias("records"),
        F.col("n_positive").alias("untimely"),
        F.col("positive_prevalence").alias("prevalence"),
        "threshold",
        "precision", "recall", "f1", "accuracy", "tp", "fp", "tn", "fn",
        "flagged", "flag_rate", "reviews_per_catch", "pr_auc", "roc_auc", "no_skill_pr_auc",
        safe_ratio(F.col("n") - F.col("n_positive"), F.col("n")).alias("baseline_accuracy"),
    )


# Compared measures and their published names.
COMPARED = (
    ("Precision", "precision"),
    ("Recall", "recall"),
    ("F1", "f1"),
    ("PR-AUC", "pr_auc"),
    ("ROC-AUC", "roc_auc"),
    ("Flag rate", "flag_rate"),
    ("Positive prevalence", "positive_prevalence"),
)


def period_comparison(scored: DataFrame, cfg: StudyConfig, score: str = "score") -> DataFrame:
    """Validation against test, one row per measure, with the change. ``scored`` carries ``year``."""
    years = scored.where(F.col("year").isin(cfg.validation_year, cfg.test_year))
    measured = evaluate(years, cfg.decision_threshold, ["year"], score)
    # Two rows from here on.
    value = lambda column, year: F.max(F.when(F.col("year") == year, F.col(column)))
    row = measured.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("metric"),
                    value(column, cfg.validation_year).alias("validation"),
                    value(column, cfg.test_year).alias("test"),
                )
                for name, column in COMPARED
            ]
        ).alias("measures")
    )
    return row.select(F.inline("measures")).withColumn("change", F.col("test") - F.col("validation"))


# --------------------------------------------------------------------------- score profiles


def positive_score_bands(ladder: DataFrame) -> DataFrame:
    """Where the late cases score (below 0.1, up to 0.6, above) and the median score of the rest."""
    low, high = passes(ladder, "score", 0.1), passes(ladder, "score", 0.6)
    pos, own = F.col("pos"), F.col("n") - F.col("pos")
    total = F.col("n_total") - F.col("pos_total")
    below = total - (F.col("n_above") - F.col("pos_above")) - own
    holds = lambda at: F.max(
        F.when((below <= at) & (at < below + own), F.col("score").cast("double"))
    )
    counts = ladder.agg(
        _total(pos).alias("untimely_total"),
        _total(F.when(~low, pos)).alias("below"),
        _total(F.when(low & ~high, pos)).alias("between"),
        _total(F.when(high, pos)).alias("above"),
        ((holds(F.floor((total - 1) / 2)) + holds(F.floor(total / 2))) / 2).alias("timely_median_score"),
    )
    share = lambda name: safe_ratio(F.col(name), F.col("untimely_total"))
    return counts.withColumns({f"{c}_share": share(c) for c in ("below", "between", "above")})


def score_summary(
    scored: DataFrame, threshold: float, by: Sequence[str] = (), score: str = "score"
) -> DataFrame:
    """Counts, mean score against observed rate, and their ratio."""
    mean = F.avg(F.col(score).cast("double"))
    rate = F.avg("target")
    return scored.groupBy(*by).agg(
        row_count().alias("n"),
        F.coalesce(F.sum("target"), F.lit(0)).cast("bigint").alias("positives"),
        F.count_if(passes(scored, score, threshold)).alias("flagged"),
        mean.alias("mean_score"),
        rate.alias("observed_rate"),
        F.try_divide(mean, rate).alias("overprediction"),
    )
