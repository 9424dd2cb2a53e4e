"""From a raw export to published tables, step by step."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Claims, StudyConfig
from ..operators import (
    audit,
    calibration,
    checks,
    encoding,
    linking,
    metrics,
    models,
    population as pop,
    ranking,
    sampling,
    symmetric,
    text_model,
)
from ..session import staging
from ..sources import Workspace, read_complaints, read_scored_file, source_row_count, split_text, write_table

LOGISTIC, TREES, TEXT = "logistic", "trees", "text"
MODEL_NAMES = {LOGISTIC: "logistic regression", TREES: "boosted trees"}


def ingest(space: Workspace, csv_path, cfg: StudyConfig) -> None:
    """Raw CSV to the two year-partitioned stores: structure, and texts."""
    cases = pop.derive_population(read_complaints(space.spark, csv_path), cfg)
    structured, texts = split_text(cases)  # each store parses the CSV: cheaper than a copy with all texts
    space.write_population(pop.drop_leakage(structured, cfg))
    space.write_narratives(texts)


def audit_population(space: Workspace) -> None:
    """Volumes, missing values, text availability, level counts and duplicate ids."""
    cases = space.population()
    tables = {
        "table01_study_population": audit.study_population_by_year(cases),
        "table04_missingness": audit.missingness(cases),
        "narrative_availability_by_year": audit.narrative_availability_by_year(cases),
        "table05_top_products": audit.value_counts(cases, "product"),
        "table06_top_companies": audit.value_counts(cases, "company"),
        "table07_channels": audit.value_counts(cases, "channel"),
        "duplicate_ids": audit.duplicate_ids(cases),
    }
    for name, table in tables.items():
        space.write_result(table, name)


def prepare_sample(space: Workspace, cfg: StudyConfig) -> None:
    """Balanced training sample with texts attached after the draw."""
    pool = space.population(*cfg.train_years)
    sample = sampling.undersample_negatives(pool, cfg)
    space.write_sample(linking.attach_narratives(sample, space.narratives(*cfg.train_years)))
    space.write_result(audit.split_design(space.sample(), cfg), "table09_split_design")
    space.write_result(audit.period_stats(space.population(), cfg), "period_stats")


def train_models(space: Workspace, cfg: StudyConfig) -> None:
    """Structured logistic model, boosted symmetric trees, and the text model when there is enough text."""
    sample = space.sample()
    logistic = models.train_exact(sample, cfg)["baseline"]
    logistic.save(space.path(f"models/{LOGISTIC}"))
    space.write_result(models.logreg_coefficients(logistic), "table17_logreg_coefficients")

    trees = symmetric.train_symmetric(sample, cfg)
    trees.save(space.path(f"models/{TREES}"))
    space.write_result(trees.importance(), "tree_feature_importance")

    text = text_model.train_text(sample, cfg)
    if text is not None:
        text.save(space.path(f"models/{TEXT}"))
        space.write_result(text.term_coefficients(), "tfidf_coefficients")


def _score(space: Workspace, name: str, year: int, cfg: StudyConfig) -> DataFrame | None:
    """Score a year with a stored model, store the scores, and return them; None without a model."""
    path = space.path(f"models/{name}")
    if not models.model_exists(space.spark, path):
        return None
    kind = {LOGISTIC: models.LinearModel, TREES: symmetric.SymmetricTrees}[name]
    scores = kind.load(space.spark, path, cfg).score(space.population(year), "complaint_id", "target")
    space.write_scores(scores, name, year)
    return space.scores(name, year)


def _aligned_scores(space: Workspace, year: int) -> DataFrame | None:
    """Stored scores of a year, or None when there are none or they cover other complaints."""
    scores = space.scores(LOGISTIC, year)
    if scores is None:
        return None
    report = linking.alignment_report(space.population(year), scores).first()
    if not report.complete:
        warnings.warn(f"scores of {year} do not match its population ({report}); skipped")
        return None
    return scores


def choose_threshold(space: Workspace, cfg: StudyConfig) -> None:
    """Model comparison and threshold sweep on the validation year."""
    year, cut = cfg.validation_year, cfg.decision_threshold
    logistic = _score(space, LOGISTIC, year, cfg)
    if logistic is None:
        raise FileNotFoundError("no logistic model: run train_models first")
    stacked = metrics.label_scores(logistic, MODEL_NAMES[LOGISTIC], cut)
    trees = _score(space, TREES, year, cfg)
    if trees is not None:
        stacked = stacked.unionByName(metrics.label_scores(trees, MODEL_NAMES[TREES], cut))
    space.write_result(metrics.model_comparison(stacked, logistic, cut), "table11_12_validation")

    path = space.path(f"models/{TEXT}")
    if models.model_exists(space.spark, path):
        texts = text_model.TextModel.load(space.spark, path).score(space.narratives(year), "complaint_id")
        both = linking.align_scores(logistic, texts.withColumnRenamed("score", "text_score"))
        if len(both.take(cfg.text_min_eval_rows + 1)) > cfg.text_min_eval_rows:
            table = metrics.narrative_model_comparison(both, "score", "text_score", cut)
            space.write_result(table, "table13_narrative_subset")

    space.write_result(metrics.threshold_sweep(logistic, cfg), "table14_threshold_sweep")
    sweep = space.result("table14_threshold_sweep")
    space.write_result(metrics.locked_threshold_summary(sweep, cfg), "locked_threshold")
    space.write_result(metrics.threshold_explorer(sweep), "threshold_explorer")


def evaluate_test(space: Workspace, cfg: StudyConfig) -> None:
    """One evaluation of the test year at the frozen threshold."""
    test = _score(space, LOGISTIC, cfg.test_year, cfg)
    if test is None:
        raise FileNotFoundError("no logistic model: run train_models first")
    counts = metrics.confusion_counts(test, cfg.decision_threshold)
    space.write_result(metrics.confusion_matrix(counts), "table15_confusion_matrix")
    validation = space.scores(LOGISTIC, cfg.validation_year)
    if validation is not None:
        pair = metrics.period_comparison(validation.unionByName(test), cfg)
        space.write_result(pair, "table16_val_vs_test")
    space.write_result(ranking.decile_lift(test), "decile_lift_test")
    space.write_result(metrics.final_test_summary(test, cfg), "final_test_summary")


def figure_tables(space: Workspace, cfg: StudyConfig) -> None:
    """The data behind each figure."""
    by_year = audit.yearly_rates(space.result("table01_study_population"))
    space.write_result(by_year.select("year", "complaints"), "fig_complaints")
    space.write_result(by_year.select("year", "untimely_rate_pct"), "fig_untimely_rate")
    space.write_result(
        space.result("narrative_availability_by_year").select("year", "availability_pct"), "fig_narrative"
    )
    space.write_result(
        space.result("table14_threshold_sweep").select("threshold", "precision", "recall"), "fig_threshold"
    )
    test = _aligned_scores(space, cfg.test_year)
    if test is None:
        return
    ladder = ranking.score_ladder(test)
    space.write_result(calibration.calibration_curve(test), "fig_calibration")
    space.write_result(metrics.with_no_skill(metrics.pr_curve(ladder), ladder), "fig_precision_recall")
    space.write_result(metrics.roc_corners(ladder), "fig_roc")
    space.write_result(ranking.score_histogram(test), "fig_score_distribution")
    space.write_result(ranking.cumulative_gains(space.result("decile_lift_test")), "fig_cumulative_gains")


def export_dashboard(space: Workspace, cfg: StudyConfig) -> None:
    """Dimensions, facts and the ranked work queue as CSV."""
    cases = space.population()
    space.publish(audit.dim_year(cases), "dim_year")
    space.publish(audit.dim_company(cases, cfg), "dim_company")
    space.publish(audit.dim_product(cases), "dim_product")
    for source, fact in (("table14_threshold_sweep", "fact_threshold"), ("decile_lift_test", "fact_decile")):
        result = space.result(source)
        if result is not None:
            space.publish(result, fact)
    test = _aligned_scores(space, cfg.test_year)
    if test is None:
        return
    queue = ranking.triage_queue(test, cfg.queue_rows, cfg.decision_threshold)
    details = ranking.queue_details(queue, space.population(cfg.test_year))
    space.publish(details.orderBy("rank"), "fact_queue")


def diagnose(space: Workspace, cfg: StudyConfig) -> None:
    """Goodness of fit, Brier score, log loss and risk groups for both evaluation years."""
    for year in (cfg.validation_year, cfg.test_year):
        scores = _aligned_scores(space, year)
        if scores is not None:
            space.write_result(calibration.risk_group_table(scores), f"risk_groups_{year}")
            groups = space.result(f"risk_groups_{year}")
            space.write_result(calibration.hosmer_lemeshow(groups), f"hosmer_lemeshow_{year}")
            space.write_result(calibration.brier_log_loss(scores), f"brier_log_loss_{year}")


def ablate(space: Workspace, cfg: StudyConfig, claims: Claims | None = None) -> None:
    """Year kept, dropped and capped. With ``claims``, the baseline must reproduce them first."""
    sample = space.sample()
    evaluated = space.population(cfg.validation_year, cfg.test_year)
    if claims is not None:
        baseline = checks.long_metrics(models.year_ablation(sample, evaluated, cfg, ["baseline"]))
        expected = checks.expected_metrics(space.spark, claims.baseline)
        gate = checks.baseline_gate(baseline, expected, claims.baseline_tolerance)
        checks.require(gate, "the baseline does not reproduce")
    space.write_result(models.year_ablation(sample, evaluated, cfg), "year_ablation")
    space.write_result(models.ablation_shift(space.result("year_ablation"), cfg), "year_ablation_shift")


def verify_claims(space: Workspace, csv_path, cfg: StudyConfig, claims: Claims = Claims()) -> DataFrame:
    """Every published claim against the stored tables."""
    test, sample = _aligned_scores(space, cfg.test_year), space.sample()
    if test is None:
        raise RuntimeError("no scores that match the test year: run evaluate_test first")
    ladder = ranking.score_ladder(test)
    levels = encoding.category_levels(sample, cfg.categorical, cfg.min_level_count)
    source = source_row_count(read_complaints(space.spark, csv_path), cfg.read_chunk_rows)
    tables = checks.all_checks(
        checks.check_duplicate_ids(space.result("duplicate_ids")),
        checks.check_pr_midrange(metrics.precision_at_recall(metrics.pr_curve(ladder))),
        checks.check_roc_shape(metrics.roc_operating_points(metrics.roc_curve(ladder))),
        checks.check_score_bands(
            metrics.positive_score_bands(ladder), claims.positives_above_threshold
        ),
        checks.check_feature_count(
            encoding.encoded_feature_count(levels, cfg.numeric), claims.encoded_features
        ),
        checks.check_text_subset(
            audit.text_subset_stats(sample), claims.text_rows, claims.text_pct, claims.text_rate_pct
        ),
        checks.check_calibration(
            calibration.top_bin_calibration(test),
            metrics.score_summary(test, cfg.decision_threshold),
            claims.flagged_rows,
        ),
        checks.check_source_rows(source, claims.source_chunks),
        checks.check_uniform_bins(ranking.uniform_bins(test)),
        checks.check_sizes(space.population(), sample, space.population(cfg.test_year), claims),
    )
    space.write_result(tables, "verification")
    space.write_result(ranking.uniform_bins(test), "uniform_bins")
    return space.result("verification")


def add_decile_file(spark: SparkSession, path: str, alternate: str | None, target: str) -> DataFrame:
    """Add the ascending decile to a scored CSV, write it, and return the per-decile summary."""
    scored = ranking.add_decile(read_scored_file(spark, path, alternate))
    write_table(scored, target)
    return ranking.decile_summary(scored)


def run_study(
    spark: SparkSession, csv_path, root: str, cfg: StudyConfig, claims: Claims | None = None
) -> Workspace:
    """All steps in order. ``claims`` adds the reproduction gate before the ablation.

    Intermediate tables live in a folder of this run, which is deleted at the end.
    """
    space = Workspace(spark, root)
    with staging(spark, "study"):
        ingest(space, csv_path, cfg)
        audit_population(space)
        prepare_sample(space, cfg)
        train_models(space, cfg)
        choose_threshold(space, cfg)
        evaluate_test(space, cfg)
        figure_tables(space, cfg)
        export_dashboard(space, cfg)
        diagnose(space, cfg)
        ablate(space, cfg, claims)
        verify_claims(space, csv_path, cfg, claims or Claims())
    return space
