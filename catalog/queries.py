"""One callable per query key: ``(spark, sf_dir) -> DataFrame``. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from duewatch.config import CATEGORICAL, RAW_TO_SHORT, Claims, StudyConfig
from duewatch.functions import as_missing, clip_probability, fill_missing_levels, passes
from duewatch.operators import (
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
from duewatch.operators.forest import Forest
from duewatch.session import stage, staged_path
from duewatch.sources import (
    Workspace,
    adapter,
    read_complaints,
    read_scored_file,
    source_row_count,
    split_text,
    write_table,
)
from duewatch.sources.adapter import ORDER_STUDY as STUDY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int = 9) -> DataFrame:
    """Comparable types: whole numbers as bigint, fractions as rounded doubles."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = F.round(column.cast("double"), digits)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, digits: int = 9) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(spark, sf_dir), digits)

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        return build

    return register


# --------------------------------------------------------------------------- inputs


def study(spark, sf) -> DataFrame:
    return adapter.population(spark, sf, STUDY.start_year, STUDY.end_year)


def train_pool(spark, sf) -> DataFrame:
    return adapter.population(spark, sf, min(STUDY.train_years), max(STUDY.train_years))


def train_sample(spark, sf) -> DataFrame:
    """Drawn on ids and labels alone; the five-table join then runs once, for the drawn rows."""
    labels = adapter.scored(spark, sf, min(STUDY.train_years), max(STUDY.train_years)).select("complaint_id", "target")
    drawn = sampling.undersample_negatives(labels, STUDY).select("complaint_id")
    return train_pool(spark, sf).join(drawn, "complaint_id", "left_semi")


def validation_scores(spark, sf) -> DataFrame:
    return adapter.scored(spark, sf, STUDY.validation_year)


def test_scores(spark, sf) -> DataFrame:
    return adapter.scored(spark, sf, STUDY.test_year)


def both_scores(spark, sf) -> DataFrame:
    return adapter.scored(spark, sf, STUDY.validation_year, STUDY.test_year)


def stored_sample(spark, sf) -> DataFrame:
    """The training sample as later steps see it: written once, leakage removed."""
    return stage(pop.drop_leakage(train_sample(spark, sf), STUDY), "train-sample")


# --------------------------------------------------------------------------- sources and sinks


@query("csv_scan")
def csv_scan(spark, sf):
    """Write the raw rows as quoted CSV, read them back by name, derive the population."""
    path = staged_path(spark, "raw-csv")
    raw = adapter.raw_complaints(spark, sf)
    named = raw.select(*[F.col(short).alias(name) for name, short in RAW_TO_SHORT.items()],
                       F.col("o_orderstatus").alias("Company response to consumer"))
    write_table(named, path)
    cases = pop.derive_population(read_complaints(spark, path), STUDY)
    return cases.groupBy("year").agg(
        F.count(F.lit(1)).alias("complaints"),
        F.sum("target").alias("untimely"),
        F.count("narrative").alias("narratives"),
        F.sum(F.length("narrative")).alias("narrative_chars"),
        F.count("sub_product").alias("sub_products"),
    )


@query("null_token_normalise")
def null_token_normalise(spark, sf):
    raw = adapter.raw_complaints(spark, sf)
    return raw.groupBy(as_missing(F.col("sub_product")).alias("sub_product")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _workspace(spark, label) -> Workspace:
    return Workspace(spark, staged_path(spark, label))


@query("population_store")
def population_store(spark, sf):
    """Year-partitioned write, then a pruned read of the test year."""
    space = _workspace(spark, "population")
    space.write_population(pop.drop_leakage(study(spark, sf), STUDY))
    return space.population(STUDY.test_year).groupBy("product").agg(
        F.count(F.lit(1)).alias("complaints"), F.sum("target").alias("untimely")
    )


@query("narrative_store")
def narrative_store(spark, sf):
    """Year-partitioned texts; the test year, and a year that has none."""
    space = _workspace(spark, "narratives")
    space.write_narratives(adapter.narratives(spark, sf, STUDY.start_year, STUDY.end_year))
    return space.narratives(STUDY.test_year, 1900).groupBy("year").agg(
        F.count(F.lit(1)).alias("narratives"), F.sum(F.length("narrative")).alias("chars")
    )


@query("sample_store")
def sample_store(spark, sf):
    space = _workspace(spark, "sample")
    space.write_sample(train_sample(spark, sf).drop("o_orderstatus", "o_orderpriority"))
    return space.sample().groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.sum("complaint_id").alias("id_sum")
    )


@query("score_store")
def score_store(spark, sf):
    """Float scores written per model and year and joined back to labels by key."""
    space = _workspace(spark, "scores")
    labels = test_scores(spark, sf)
    space.write_scores(labels, "given", STUDY.test_year)
    stored = space.scores("given", STUDY.test_year).select("complaint_id", "model", "score")
    joined = linking.align_scores(labels.select("complaint_id", "target"), stored)
    return joined.groupBy("model", "target").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("score").cast("double")).alias("mean_score")
    )


@query("csv_table_sink")
def csv_table_sink(spark, sf):
    path = staged_path(spark, "table-csv")
    write_table(audit.rate_table(study(spark, sf), "state"), path)
    schema = "state string, complaints bigint, untimely bigint, untimely_rate double"
    return spark.read.schema(schema).option("header", True).csv(path)


def _scored_file(spark, sf) -> DataFrame:
    """A scored CSV on the shared folder, found through the alternate path."""
    path = staged_path(spark, "scored-csv")
    rows = test_scores(spark, sf).select(
        "complaint_id",
        F.round(F.col("score").cast("double"), 3).alias("pred_proba"),
        F.col("target").alias("actually_untimely"),
    )
    write_table(rows, path)
    return read_scored_file(spark, f"{path}-absent", path)


@query("scored_file_decile")
def scored_file_decile(spark, sf):
    return ranking.decile_summary(ranking.add_decile(_scored_file(spark, sf)))


@query("scored_file_missing")
def scored_file_missing(spark, sf):
    """A scored CSV with missing scores in several spellings: the rest is binned by rank."""
    path = staged_path(spark, "scored-csv")
    key = F.col("complaint_id")
    score = F.round(F.col("score").cast("double"), 3).cast("string")
    rows = test_scores(spark, sf).select(
        "complaint_id",
        F.when(key % 10 == 0, "NA").when(key % 10 == 1, "nan").when(key % 10 == 2, "").otherwise(score).alias("pred_proba"),
        F.when(key % 9 == 0, "NA").otherwise(F.col("target").cast("string")).alias("actually_untimely"),
    )
    write_table(rows, path)
    return ranking.decile_summary(ranking.add_decile(read_scored_file(spark, path)))


@query("fact_threshold")
def fact_threshold(spark, sf):
    """The sweep as stored by the threshold step and re-exported unchanged."""
    space = _workspace(spark, "facts")
    space.write_result(metrics.threshold_sweep(validation_scores(spark, sf), STUDY), "threshold_sweep")
    return space.result("threshold_sweep")


@query("fact_decile")
def fact_decile(spark, sf):
    space = _workspace(spark, "facts")
    space.write_result(ranking.decile_lift(test_scores(spark, sf)), "decile_lift")
    return space.result("decile_lift")


@query("source_row_count")
def source_rows(spark, sf):
    return source_row_count(adapter.table(spark, sf, "lineitem"), 5_000)


# --------------------------------------------------------------------------- projections, filters


@query("calendar_features")
def calendar_features(spark, sf):
    dated = pop.with_calendar(adapter.raw_complaints(spark, sf))
    return dated.select("complaint_id", "date_received", "year", "month", "quarter")


@query("study_population")
def study_population(spark, sf):
    cases = pop.derive_population(adapter.raw_complaints(spark, sf), STUDY)
    structured, _ = split_text(cases)
    return structured.select("complaint_id", "year", "target", "has_narrative", "sub_issue")


@query("text_structure_split")
def text_structure_split(spark, sf):
    cases = pop.derive_population(adapter.raw_complaints(spark, sf), STUDY)
    structured, texts = split_text(cases)
    parts = [
        structured.groupBy("year").agg(F.lit("structured").alias("part"), F.count(F.lit(1)).alias("n")),
        texts.groupBy("year").agg(F.lit("narratives").alias("part"), F.count("narrative").alias("n")),
    ]
    return parts[0].unionByName(parts[1])


@query("leakage_guard")
def leakage_guard(spark, sf):
    return pop.leakage_report(study(spark, sf), STUDY)


@query("missing_level_fill")
def missing_level_fill(spark, sf):
    """Null levels become explicit; a column that is absent becomes that level throughout."""
    filled = fill_missing_levels(study(spark, sf).drop("state"), CATEGORICAL)
    return filled.groupBy("sub_product", "sub_issue", "state").agg(F.count(F.lit(1)).alias("n"))


@query("feature_projection")
def feature_projection(spark, sf):
    cases = fill_missing_levels(adapter.population(spark, sf, STUDY.validation_year), CATEGORICAL)
    return cases.select("complaint_id", *STUDY.features)


@query("period_class_filter")
def period_class_filter(spark, sf):
    rows = pop.in_years(adapter.scored(spark, sf, min(STUDY.train_years), max(STUDY.train_years)), STUDY.train_years)
    return rows.where(F.col("target") == 1).select("complaint_id", "year")


@query("text_available_guard")
def text_available_guard(spark, sf):
    """Is there enough text to train on, and to evaluate on?"""
    sample = train_sample(spark, sf)
    evaluated = adapter.population(spark, sf, STUDY.validation_year)
    counted = lambda df, part, least: df.agg(
        F.lit(part).alias("part"),
        F.count_if("has_narrative").alias("text_rows"),
        (F.count_if("has_narrative") >= least).alias("enough"),
    )
    return counted(sample, "train", STUDY.text_min_train_rows).unionByName(
        counted(evaluated, "validation", STUDY.text_min_eval_rows + 1)
    )


@query("year_variant")
def year_variant(spark, sf):
    cases = adapter.scored(spark, sf, STUDY.start_year, STUDY.end_year)
    capped = pop.year_variant(cases, "capped", STUDY)
    dropped = pop.year_variant(cases, "dropped", STUDY)
    has_year = F.lit("year" in dropped.columns)
    return capped.groupBy("year").agg(F.count(F.lit(1)).alias("n"), has_year.alias("dropped_has_year"))


@query("probability_clip")
def probability_clip(spark, sf):
    rows = test_scores(spark, sf)
    return rows.select(
        "complaint_id",
        F.round(F.ln(clip_probability(F.col("score"))), 9).alias("log_p"),
        F.round(F.ln(clip_probability(F.col("score") - 1)), 9).alias("log_floor"),
    )


@query("flag_at_threshold")
def flag_at_threshold(spark, sf):
    rows = test_scores(spark, sf)
    return rows.select(
        "complaint_id",
        *[passes(rows, "score", t).cast("int").alias(f"at_{round(t * 100):03d}") for t in STUDY.sweep],
    )


@query("temporal_split")
def temporal_split(spark, sf):
    split = pop.temporal_split(adapter.scored(spark, sf, STUDY.start_year, STUDY.end_year), STUDY)
    return split.groupBy("period", "year").agg(
        F.count(F.lit(1)).alias("records"), F.sum("target").alias("untimely")
    )


# --------------------------------------------------------------------------- joins


@query("train_with_narratives")
def train_with_narratives(spark, sf):
    texts = adapter.narratives(spark, sf, min(STUDY.train_years), max(STUDY.train_years))
    joined = linking.attach_narratives(train_sample(spark, sf), texts)
    return joined.select("complaint_id", "target", F.md5("narrative").alias("text_md5"))


@query("narrative_semi_join")
def narrative_semi_join(spark, sf):
    texts = adapter.narratives(spark, sf, min(STUDY.train_years), max(STUDY.train_years))
    kept = linking.wanted_narratives(train_sample(spark, sf), texts)
    return kept.select("complaint_id", "year", F.length("narrative").alias("chars"))


@query("validation_narrative_subset")
def validation_narrative_subset(spark, sf):
    cases = adapter.population(spark, sf, STUDY.validation_year)
    subset = linking.narrative_subset(cases, adapter.narratives(spark, sf, STUDY.validation_year))
    return subset.select("complaint_id", "target", F.length("narrative").alias("chars"))


@query("score_label_join")
def score_label_join(spark, sf):
    labels = adapter.population(spark, sf, STUDY.test_year)
    return linking.alignment_report(labels, test_scores(spark, sf))


@query("val_vs_test")
def val_vs_test(spark, sf):
    return metrics.period_comparison(both_scores(spark, sf), STUDY)


# --------------------------------------------------------------------------- audit tables


@query("study_population_by_year")
def study_population_by_year(spark, sf):
    return audit.study_population_by_year(adapter.scored(spark, sf, STUDY.start_year, STUDY.end_year))


@query("missingness")
def missingness(spark, sf):
    return audit.missingness(study(spark, sf))


@query("narrative_availability_by_year")
def narrative_availability_by_year(spark, sf):
    return audit.narrative_availability_by_year(study(spark, sf))


@query("top_products")
def top_products(spark, sf):
    return audit.value_counts(study(spark, sf), "product")


@query("top_companies")
def top_companies(spark, sf):
    return audit.value_counts(study(spark, sf), "company")


@query("top_companies_head")
def top_companies_head(spark, sf):
    return audit.head(audit.value_counts(study(spark, sf), "company"), 10)


@query("sub_product_counts")
def sub_product_counts(spark, sf):
    """Value counts of a column with nulls: the null level is counted."""
    return audit.value_counts(study(spark, sf), "sub_product")


@query("channels")
def channels(spark, sf):
    return audit.value_counts(study(spark, sf), "channel")


@query("duplicate_ids")
def duplicate_ids(spark, sf):
    """Line items repeat their (order, line) key, so there is something to find."""
    lines = adapter.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("complaint_id")
    )
    return audit.duplicate_ids(lines)


@query("period_stats")
def period_stats(spark, sf):
    return audit.period_stats(both_scores(spark, sf), STUDY)


@query("natural_prevalence")
def natural_prevalence(spark, sf):
    """Evaluation periods of the split keep every row of their year."""
    split = pop.temporal_split(adapter.scored(spark, sf, STUDY.start_year, STUDY.end_year), STUDY)
    return audit.period_stats(split.where(F.col("period") != "train"), STUDY)


@query("split_design")
def split_design(spark, sf):
    pool = adapter.scored(spark, sf, min(STUDY.train_years), max(STUDY.train_years))
    return audit.split_design(sampling.undersample_negatives(pool, STUDY), STUDY)


@query("rate_table")
def rate_table(spark, sf):
    return audit.rate_table(study(spark, sf), "sub_issue", 10)


@query("dim_year")
def dim_year(spark, sf):
    return audit.dim_year(adapter.scored(spark, sf, STUDY.start_year, STUDY.end_year))


@query("dim_company")
def dim_company(spark, sf):
    return audit.dim_company(study(spark, sf), STUDY)


@query("dim_product")
def dim_product(spark, sf):
    return audit.dim_product(study(spark, sf))


@query("text_subset_stats")
def text_subset_stats(spark, sf):
    return audit.text_subset_stats(train_sample(spark, sf))


@query("fig_complaints")
def fig_complaints(spark, sf):
    table = audit.study_population_by_year(adapter.scored(spark, sf, STUDY.start_year, STUDY.end_year))
    return audit.yearly_rates(table).select("year", "complaints")


@query("fig_narrative")
def fig_narrative(spark, sf):
    return audit.narrative_availability_by_year(study(spark, sf)).select("year", "availability_pct")


@query("fig_untimely_rate")
def fig_untimely_rate(spark, sf):
    table = audit.study_population_by_year(adapter.scored(spark, sf, STUDY.start_year, STUDY.end_year))
    return audit.yearly_rates(table).select("year", "untimely_rate_pct")


# --------------------------------------------------------------------------- sampling


@query("undersample_negatives")
def undersample_negatives(spark, sf):
    pool = adapter.scored(spark, sf, min(STUDY.train_years), max(STUDY.train_years))
    return sampling.undersample_negatives(pool, STUDY).select("complaint_id", "year", "target")


# --------------------------------------------------------------------------- ranking and bins


@query("decile_lift")
def decile_lift(spark, sf):
    return ranking.decile_lift(test_scores(spark, sf))


@query("cumulative_gains")
def cumulative_gains(spark, sf):
    return ranking.cumulative_gains(ranking.decile_lift(test_scores(spark, sf)))


@query("add_decile")
def add_decile(spark, sf):
    rows = test_scores(spark, sf).select(
        "complaint_id", F.round(F.col("score").cast("double"), 3).alias("pred_proba")
    )
    return ranking.add_decile(rows)


@query("decile_summary")
def decile_summary(spark, sf):
    rows = both_scores(spark, sf).select(
        F.round(F.col("score").cast("double"), 3).alias("pred_proba"),
        F.col("target").alias("actually_untimely"),
    )
    return ranking.decile_summary(ranking.add_decile(rows))


@query("risk_groups")
def risk_groups(spark, sf):
    return ranking.risk_groups(test_scores(spark, sf)).select("complaint_id", "rank", "risk_group")


@query("triage_rank")
def triage_rank(spark, sf):
    rows = test_scores(spark, sf).select("complaint_id", "score")
    return ranking.triage_rank(rows).select("complaint_id", "rank", "percentile", "decile")


@query("uniform_bins")
def uniform_bins(spark, sf):
    return ranking.uniform_bins(test_scores(spark, sf))


@query("top_bin_calibration")
def top_bin_calibration(spark, sf):
    return calibration.top_bin_calibration(test_scores(spark, sf))


@query("score_histogram")
def score_histogram(spark, sf):
    return ranking.score_histogram(test_scores(spark, sf))


@query("triage_queue")
def triage_queue(spark, sf):
    queue = ranking.triage_queue(test_scores(spark, sf), STUDY.queue_rows, STUDY.decision_threshold)
    return ranking.queue_details(queue, adapter.population(spark, sf, STUDY.test_year))


@query("triage_queue_head")
def triage_queue_head(spark, sf):
    """A queue shorter than the population, so that it cuts."""
    queue = ranking.triage_queue(test_scores(spark, sf), 150, STUDY.decision_threshold)
    return ranking.queue_details(queue, adapter.population(spark, sf, STUDY.test_year))


@query("queue_summary")
def queue_summary(spark, sf):
    queue = ranking.triage_queue(test_scores(spark, sf), 200, STUDY.decision_threshold)
    return ranking.queue_summary(queue)


@query("precision_at_recall")
def precision_at_recall(spark, sf):
    curve = metrics.pr_curve(ranking.score_ladder(test_scores(spark, sf)))
    return metrics.precision_at_recall(curve)


# --------------------------------------------------------------------------- metrics


@query("confusion_counts")
def confusion_counts(spark, sf):
    return metrics.confusion_counts(test_scores(spark, sf), STUDY.decision_threshold)


@query("confusion_matrix")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(
        metrics.confusion_counts(test_scores(spark, sf), STUDY.decision_threshold)
    )


@query("positive_score_bands")
def positive_score_bands(spark, sf):
    return metrics.positive_score_bands(ranking.score_ladder(test_scores(spark, sf)))


@query("score_summary")
def score_summary(spark, sf):
    return metrics.score_summary(both_scores(spark, sf), STUDY.decision_threshold, by=["year"])


@query("metrics_at_threshold")
def metrics_at_threshold(spark, sf):
    return metrics.metrics_at_threshold(test_scores(spark, sf), STUDY.decision_threshold)


@query("ranking_metrics")
def ranking_metrics(spark, sf):
    return metrics.ranking_metrics(both_scores(spark, sf), by=["year"])


@query("pr_curve")
def pr_curve(spark, sf):
    return metrics.pr_curve(ranking.score_ladder(test_scores(spark, sf)))


@query("roc_curve")
def roc_curve(spark, sf):
    return metrics.roc_curve(ranking.score_ladder(test_scores(spark, sf)))


@query("roc_corners")
def roc_corners(spark, sf):
    return metrics.roc_corners(ranking.score_ladder(test_scores(spark, sf)))


@query("roc_operating_points")
def roc_operating_points(spark, sf):
    return metrics.roc_operating_points(
        metrics.roc_curve(ranking.score_ladder(test_scores(spark, sf)))
    )


@query("baseline_metrics")
def baseline_metrics(spark, sf):
    return metrics.baseline_metrics(validation_scores(spark, sf))


@query("threshold_sweep")
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(validation_scores(spark, sf), STUDY)


@query("locked_threshold_summary")
def locked_threshold_summary(spark, sf):
    sweep = metrics.threshold_sweep(validation_scores(spark, sf), STUDY)
    return metrics.locked_threshold_summary(sweep, STUDY)


MODELS = {"score": "logistic regression", "score_b": "boosted trees"}


@query("model_comparison")
def model_comparison(spark, sf):
    scored = validation_scores(spark, sf)
    stacked = metrics.stack_scores(scored, MODELS, STUDY.decision_threshold)
    return metrics.model_comparison(stacked, scored, STUDY.decision_threshold)


def _text_scored(spark, sf) -> DataFrame:
    """Validation rows with text, a structured float score and a text double score."""
    keys = adapter.narratives(spark, sf, STUDY.validation_year).select("complaint_id")
    rows = validation_scores(spark, sf).join(keys, "complaint_id", "left_semi")
    return rows.withColumn("text_score", F.round(F.col("score_b").cast("double"), 3))


@query("narrative_model_comparison")
def narrative_model_comparison(spark, sf):
    return metrics.narrative_model_comparison(
        _text_scored(spark, sf), "score", "text_score", STUDY.decision_threshold
    )


@query("ensemble_score")
def ensemble_score(spark, sf):
    both = metrics.ensemble_score(_text_scored(spark, sf), "text_score", "score")
    return both.select("complaint_id", "combined")


@query("final_test_summary")
def final_test_summary(spark, sf):
    return metrics.final_test_summary(test_scores(spark, sf), STUDY)


@query("hosmer_lemeshow", digits=6)
def hosmer_lemeshow(spark, sf):
    return calibration.hosmer_lemeshow(calibration.risk_group_table(test_scores(spark, sf)))


@query("risk_group_table")
def risk_group_table(spark, sf):
    return calibration.risk_group_table(test_scores(spark, sf))


@query("brier_log_loss")
def brier_log_loss(spark, sf):
    return calibration.brier_log_loss(test_scores(spark, sf))


@query("calibration_curve")
def calibration_curve(spark, sf):
    return calibration.calibration_curve(test_scores(spark, sf))


@query("fig_threshold")
def fig_threshold(spark, sf):
    sweep = metrics.threshold_sweep(validation_scores(spark, sf), STUDY)
    return sweep.select("threshold", "precision", "recall")


@query("fig_pr")
def fig_pr(spark, sf):
    ladder = ranking.score_ladder(test_scores(spark, sf))
    return metrics.with_no_skill(metrics.pr_curve(ladder), ladder)


@query("fig_roc")
def fig_roc(spark, sf):
    return metrics.roc_curve(ranking.score_ladder(test_scores(spark, sf))).select("fpr", "tpr")


@query("threshold_explorer")
def threshold_explorer(spark, sf):
    return metrics.threshold_explorer(metrics.threshold_sweep(validation_scores(spark, sf), STUDY))


# --------------------------------------------------------------------------- features


@query("category_levels")
def category_levels(spark, sf):
    return encoding.category_levels(stored_sample(spark, sf), STUDY.categorical, STUDY.min_level_count)


@query("encoded_feature_count")
def encoded_feature_count(spark, sf):
    levels = encoding.category_levels(stored_sample(spark, sf), STUDY.categorical)
    return encoding.encoded_feature_count(levels, STUDY.numeric)


@query("scaler_stats")
def scaler_stats(spark, sf):
    return encoding.scaler_stats(stored_sample(spark, sf), STUDY.numeric)


@query("one_hot_vectors")
def one_hot_vectors(spark, sf):
    """Encoded validation rows, as (case, column, value); unseen levels have no column."""
    train = stored_sample(spark, sf)
    encoder = encoding.Encoder.fit(train, STUDY)
    cases = adapter.population(spark, sf, STUDY.validation_year)
    vectors = encoder.transform(cases, encoder.scaling).withColumn("v", F.unwrap_udt("features"))
    # Cases whose vector is mostly non-zero are stored densely.
    places = F.coalesce("v.indices", F.sequence(F.lit(0), F.size("v.values") - 1))
    cells = vectors.select("complaint_id", F.inline(F.arrays_zip(places.alias("position"), F.col("v.values").alias("value"))))
    named = encoder.names(STUDY.numeric)
    return cells.where("value <> 0").join(named, "position").select("complaint_id", "feature", "value")


@query("tfidf_terms", digits=6)
def tfidf_terms(spark, sf):
    """Vocabulary statistics over all narratives."""
    docs = adapter.narratives(spark, sf)
    return text_model.vocabulary(text_model.term_statistics(docs), STUDY)


@query("tfidf_features", digits=6)
def tfidf_features(spark, sf):
    return text_model.tfidf_weights(_train_text(spark, sf), STUDY)


def _train_text(spark, sf) -> DataFrame:
    texts = adapter.narratives(spark, sf, min(STUDY.train_years), max(STUDY.train_years))
    subset = linking.narrative_subset(stored_sample(spark, sf).select("complaint_id", "target"), texts)
    return stage(subset, "train-text")


# --------------------------------------------------------------------------- models


@query("logreg_coefficients")
def logreg_coefficients(spark, sf):
    return models.logreg_coefficients(models.train_logreg(stored_sample(spark, sf), STUDY))


@query("score_population")
def score_population(spark, sf):
    model = models.train_logreg(stored_sample(spark, sf), STUDY)
    return model.score(adapter.population(spark, sf, STUDY.test_year), "complaint_id", "year")


def _given_model(spark, sf) -> models.LinearModel:
    """A model whose weights follow from the sample's counts by a formula."""
    cells = encoding.stack_categories(
        fill_missing_levels(stored_sample(spark, sf), STUDY.categorical), STUDY.categorical, "target"
    )
    weights = cells.groupBy("feature", "level").agg((F.round(F.avg("target"), 6) - 0.125).alias("weight"))
    weights = stage(weights, "given-weights", partition_by=("feature",))
    numbers = {"year": (1997.0, 2.0, 0.25), "month": (6.5, 4.0, -0.125), "quarter": (2.5, 1.0, 0.0625)}
    return models.LinearModel(tuple(STUDY.categorical), weights, numbers, -1.5, weights)


@query("given_weight_scores", digits=5)
def given_weight_scores(spark, sf):
    """Scoring with a given weight table, unseen levels included; the same path as a fitted model."""
    scored = _given_model(spark, sf).score(adapter.population(spark, sf, STUDY.test_year), "complaint_id", "year")
    return scored


@query("given_model_store", digits=5)
def given_model_store(spark, sf):
    """The given model written, read back and scored."""
    path = staged_path(spark, "given-model")
    _given_model(spark, sf).save(path)
    loaded = models.LinearModel.load(spark, path, STUDY)
    return loaded.score(adapter.population(spark, sf, STUDY.validation_year), "complaint_id")


def _given_forest(spark) -> Forest:
    """Twenty trees of three levels, their nodes numbered level by level and filled by a rule."""
    ids = spark.range(20).select(F.col("id").cast("int").alias("tree"))
    nodes = ids.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(14))))
    draw = lambda a, b, n: F.pmod(F.col("tree") * a + F.col("node") * b, F.lit(n))
    names = F.array(*[F.lit(name) for name in ("month", "quarter", "year", "part")])
    border = F.array(draw(3, 5, 11) + 1.5, draw(1, 2, 3) + 1.5, draw(1, 1, 5) + 1995.5, draw(7, 3, 16) + 0.5)
    kind, inner = draw(7, 5, 4) + 1, F.col("node") < 7
    filled = nodes.select(
        "tree", "node",
        F.when(inner, F.element_at(names, kind)).alias("feature"),
        F.when(inner, F.element_at(border, kind)).cast("double").alias("border"),
        F.when(inner, 2 * F.col("node") + 1).alias("low"),
        F.when(inner, 2 * F.col("node") + 2).alias("high"),
        F.when(~inner, (draw(31, 17, 101) - 50) / F.lit(64.0)).alias("value"),
    )
    return Forest(filled, -1.0)


@query("given_tree_scores", digits=5)
def given_tree_scores(spark, sf):
    """A given forest written as a table of nodes, read back, compiled and scored; ``part`` is missing for some."""
    path = staged_path(spark, "given-forest")
    _given_forest(spark).save(path)
    part = F.when(F.col("complaint_id") % 9 > 0, F.col("complaint_id") % 17)
    cases = adapter.population(spark, sf, STUDY.test_year).withColumn("part", part)
    return Forest.load(spark, path).score(cases, "complaint_id")


@query("ordered_target_rates", digits=9)
def ordered_target_rates(spark, sf):
    """Late rate of each case's levels among the cases before it in the drawn order."""
    ranked = symmetric.in_drawn_order(stored_sample(spark, sf), STUDY)
    rates = symmetric.ordered_rates(ranked, STUDY.categorical, symmetric.sample_start(ranked)[0])
    return rates.join(ranked.select("rank", "complaint_id"), "rank").select("complaint_id", "feature", "rate")


@query("first_split_gains", digits=6)
def first_split_gains(spark, sf):
    """What every border of a given grid gains as the first split, as a share of the sample's rows."""
    train = stored_sample(spark, sf)
    grid = {f"{c}_rate": [k / 32 for k in range(1, 16)] for c in STUDY.categorical}
    grid |= {"year_num": [1994.5, 1996.5], "month_num": [k + 0.5 for k in range(1, 12)], "quarter_num": [1.5, 2.5, 3.5]}
    rows = train.agg(F.count(F.lit(1)).alias("rows"))
    gains = symmetric.first_gains(train, STUDY, {name: grid[name] for name in symmetric.feature_names(STUDY)})
    return gains.join(F.broadcast(rows)).select("feature", "border", (F.col("gain") / F.col("rows")).alias("gain"))


_symmetric_models: dict[tuple[str, str], str] = {}


def _symmetric_model(spark, sf) -> symmetric.SymmetricTrees:
    """All trees of the study, fitted once in a session and read back from their store."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _symmetric_models:
        path = staged_path(spark, "symmetric")
        symmetric.train_symmetric(stored_sample(spark, sf), STUDY).save(path)
        _symmetric_models[key] = path
    return symmetric.SymmetricTrees.load(spark, _symmetric_models[key], STUDY)


@query("symmetric_tree_importance")
def symmetric_tree_importance(spark, sf):
    return _symmetric_model(spark, sf).importance()


@query("symmetric_tree_scores")
def symmetric_tree_scores(spark, sf):
    """Cases of the test year scored by symmetric trees; ``tests/test_symmetric.py`` has the plain fit."""
    cases = adapter.population(spark, sf, STUDY.test_year)
    return _symmetric_model(spark, sf).score(cases, "complaint_id", "year")


@query("target_encoding", digits=9)
def target_encoding(spark, sf):
    """Cross-fitted late rates per level, the categorical inputs of the trees."""
    return models.target_encoding(stored_sample(spark, sf), STUDY.categorical)


@query("gbt_invariants")
def gbt_invariants(spark, sf):
    """One probability per case, and importances that add up to a hundred."""
    model = _tree_model(spark, sf)
    cases = adapter.population(spark, sf, STUDY.validation_year)
    scores = model.score(cases, "complaint_id").agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_distinct("complaint_id").alias("cases"),
        F.count_if(F.col("score").between(0, 1)).alias("probabilities"),
    )
    return scores.withColumn("importance", F.round(model.importance().agg(F.sum("importance")).scalar(), 6))


@query("ablation_invariants")
def ablation_invariants(spark, sf):
    """Cases per variant and year, and whether capping left the ranking within each year as it was."""
    evaluated = adapter.population(spark, sf, STUDY.validation_year, STUDY.test_year)
    table = models.year_ablation(stored_sample(spark, sf), evaluated, STUDY)
    at = lambda variant, column: F.max(F.when(F.col("variant") == variant, F.col(column)))
    return table.groupBy("period").agg(
        F.count(F.lit(1)).alias("variants"),
        *(
            (F.abs(at("baseline", c) - at("capped", c)) < 0.002).alias(f"{c}_agrees")
            for c in ("pr_auc", "roc_auc")
        ),
    )


@query("logreg_gradient", digits=3)
def logreg_gradient(spark, sf):
    """At the fitted weights the objective is flat: its slope per encoded column, over the rows."""
    train = stored_sample(spark, sf)
    encoder = encoding.Encoder.fit(train, STUDY)
    model = models.train_logreg(train, STUDY, encoder)
    gap = models.sigmoid(F.col("margin")) - F.col("target")
    rows = fill_missing_levels(model.margin(train), STUDY.categorical)
    sums = encoding.stack_categories(rows.withColumn("gap", gap), STUDY.categorical, "gap")
    names = encoder.levels.select("feature", "level", F.concat(F.lit("cat__"), "feature", F.lit("_"), "encoded").alias("name"))
    loss = sums.join(names, ["feature", "level"]).groupBy(F.col("name").alias("feature")).agg(F.sum("gap").alias("loss"))
    slope = loss.join(model.coefficients, "feature")
    return slope.select("feature", F.abs(F.round((F.col("loss") + F.col("coefficient") / STUDY.logistic_c) / train.count(), 3)).alias("slope"))


@query("logreg_slopes", digits=6)
def logreg_slopes(spark, sf):
    """Slopes left at an exact fit: every encoded column, the numbers and the intercept, summed over all rows."""
    train = stored_sample(spark, sf)
    encoder = encoding.Encoder.fit(train, STUDY)
    model = models.train_exact(train, STUDY, encoder=encoder)["baseline"]
    gap = models.sigmoid(F.col("margin")) - F.col("target")
    rows = fill_missing_levels(model.margin(train), STUDY.categorical).withColumn("gap", gap)
    numbers = {f"num__{n}": F.sum(F.col("gap") * encoding.scaled(n, m, std)) for n, (m, std, _) in model.numbers.items()}
    cells = [F.struct(F.lit(x).alias("feature"), F.col(x).alias("loss")) for x in (*numbers, "(intercept)")]
    whole = rows.agg(*(total.alias(x) for x, total in numbers.items()), F.sum("gap").alias("(intercept)")).select(F.inline(F.array(*cells)))
    names = encoder.levels.select("feature", "level", F.concat(F.lit("cat__"), "feature", F.lit("_"), "encoded").alias("name"))
    by_level = encoding.stack_categories(rows, STUDY.categorical, "gap").groupBy("feature", "level").agg(F.sum("gap").alias("gap"))
    loss = by_level.join(names, ["feature", "level"]).groupBy(F.col("name").alias("feature")).agg(F.sum("gap").alias("loss"))
    slope = STUDY.logistic_c * F.col("loss") + F.coalesce("coefficient", F.lit(0.0))
    return loss.unionByName(whole).join(model.coefficients, "feature", "left").select("feature", F.abs(F.round(slope, 6)).alias("slope"))


@query("given_coefficient_table", digits=6)
def given_coefficient_table(spark, sf):
    """The published coefficient table of a given model, with the place of every row in it."""
    model = _given_model(spark, sf)
    named = model.weights.select(F.concat(F.lit("cat__"), "feature", F.lit("_"), "level").alias("feature"), F.col("weight").alias("coefficient"))
    numbers = [(f"num__{n}", w) for n, (*_, w) in model.numbers.items()]
    numbered = named.unionByName(spark.createDataFrame(numbers, "feature string, coefficient double"))
    table = models.logreg_coefficients(replace(model, coefficients=numbered)).withColumn("at", F.monotonically_increasing_id())
    return ranking.global_rank(table, F.col("at")).withColumnRenamed("rank", "place").drop("at", "rank_rows")


@query("given_ablation_shift")
def given_ablation_shift(spark, sf):
    """The shift table over three given scores of every case in place of the refits."""
    scored = adapter.scored(spark, sf, STUDY.validation_year, STUDY.test_year).withColumn("low", F.least("score", "score_b"))
    given = [F.struct(F.lit(v).alias("variant"), F.col(c).alias("score")) for v, c in zip(models.VARIANTS, ("score", "score_b", "low"))]
    stacked = scored.select(F.col("year").alias("period"), "target", F.inline(F.array(*given)))
    measured = metrics.evaluate(stacked, STUDY.decision_threshold, ["variant", "period"])
    return models.ablation_shift(measured, STUDY)


@query("given_text_scores", digits=6)
def given_text_scores(spark, sf):
    """Texts of the validation year by a stored text model whose term weights follow from the terms by a rule."""
    index = text_model.TermIndex.fit(_train_text(spark, sf), STUDY)
    weights = tuple((len(term) * 7 % 11 - 5) / 8 for term in index.terms)
    path = staged_path(spark, "given-text")
    text_model.TextModel(index, weights, -0.75).save(path)
    texts = adapter.narratives(spark, sf, STUDY.validation_year, STUDY.validation_year)
    return text_model.TextModel.load(spark, path).score(texts, "complaint_id")


@query("model_store")
def model_store(spark, sf):
    """Score with a stored model read back from its tables."""
    path = staged_path(spark, "model")
    models.train_logreg(stored_sample(spark, sf), STUDY).save(path)
    loaded = models.LinearModel.load(spark, path, STUDY)
    scores = loaded.score(adapter.population(spark, sf, STUDY.validation_year), "target")
    return metrics.ranking_metrics(scores)


_tree_models: dict[tuple[str, str], str] = {}


def _tree_model(spark, sf) -> models.TreeModel:
    """The boosted trees of a table folder, fitted once in a session and read back from their store."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _tree_models:
        path = staged_path(spark, "trees")
        models.train_gbt(stored_sample(spark, sf), STUDY).save(path)
        _tree_models[key] = path
    return models.TreeModel.load(spark, _tree_models[key], STUDY)


@query("gbt_importance")
def gbt_importance(spark, sf):
    return _tree_model(spark, sf).importance()


@query("gbt_scores")
def gbt_scores(spark, sf):
    cases = adapter.population(spark, sf, STUDY.validation_year)
    return _tree_model(spark, sf).score(cases, "complaint_id", "year")


def _text_model(spark, sf):
    return text_model.train_text(_train_text(spark, sf), STUDY)


@query("text_term_coefficients")
def text_term_coefficients(spark, sf):
    return _text_model(spark, sf).term_coefficients()


@query("top_terms")
def top_terms(spark, sf):
    return text_model.top_terms(_text_model(spark, sf).term_coefficients())


@query("text_scores")
def text_scores(spark, sf):
    docs = adapter.narratives(spark, sf, STUDY.validation_year)
    return _text_model(spark, sf).score(docs, "complaint_id")


@query("year_ablation")
def year_ablation(spark, sf):
    evaluated = adapter.population(spark, sf, STUDY.validation_year, STUDY.test_year)
    return models.year_ablation(stored_sample(spark, sf), evaluated, STUDY)


@query("ablation_shift")
def ablation_shift(spark, sf):
    evaluated = adapter.population(spark, sf, STUDY.validation_year, STUDY.test_year)
    return models.ablation_shift(models.year_ablation(stored_sample(spark, sf), evaluated, STUDY), STUDY)


# --------------------------------------------------------------------------- checks


@query("check_duplicate_ids")
def check_duplicate_ids(spark, sf):
    return checks.check_duplicate_ids(audit.duplicate_ids(study(spark, sf)))


@query("check_pr_midrange")
def check_pr_midrange(spark, sf):
    curve = metrics.pr_curve(ranking.score_ladder(test_scores(spark, sf)))
    return checks.check_pr_midrange(metrics.precision_at_recall(curve))


@query("check_roc_shape")
def check_roc_shape(spark, sf):
    roc = metrics.roc_curve(ranking.score_ladder(test_scores(spark, sf)))
    return checks.check_roc_shape(metrics.roc_operating_points(roc))


@query("check_score_bands")
def check_score_bands(spark, sf):
    """The bands against the confusion counts at the same border."""
    scored = test_scores(spark, sf)
    caught = metrics.confusion_counts(scored, STUDY.decision_threshold).first()["tp"]
    return checks.check_score_bands(metrics.positive_score_bands(ranking.score_ladder(scored)), caught)


@query("check_feature_count")
def check_feature_count(spark, sf):
    """The counted levels against the width of a fitted encoder."""
    train = stored_sample(spark, sf)
    levels = encoding.category_levels(train, STUDY.categorical)
    width = encoding.Encoder.fit(train, STUDY).width + len(STUDY.numeric)
    return checks.check_feature_count(encoding.encoded_feature_count(levels, STUDY.numeric), width)


@query("check_text_subset")
def check_text_subset(spark, sf):
    """The flag of the sample against the texts that join to it."""
    sample = stored_sample(spark, sf)
    texts = adapter.narratives(spark, sf, min(STUDY.train_years), max(STUDY.train_years))
    with_text = linking.narrative_subset(sample.select("complaint_id", "target"), texts)
    found = with_text.agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("rate")).first()
    pct = round(100 * found["n"] / max(1, sample.count()), 2)
    rate = round(100 * (found["rate"] or 0.0), 2)
    return checks.check_text_subset(audit.text_subset_stats(sample), found["n"], pct, rate)


@query("check_calibration")
def check_calibration(spark, sf):
    """Top groups, and the flagged rows against the confusion counts."""
    scores = test_scores(spark, sf)
    counts = metrics.confusion_counts(scores, STUDY.decision_threshold).first()
    return checks.check_calibration(
        calibration.top_bin_calibration(scores),
        metrics.score_summary(scores, STUDY.decision_threshold),
        counts["tp"] + counts["fp"],
    )


@query("check_uniform_bins")
def check_uniform_bins(spark, sf):
    return checks.check_uniform_bins(ranking.uniform_bins(test_scores(spark, sf)))


@query("check_sizes")
def check_sizes(spark, sf):
    """Sizes of the joined tables against those of the order table alone."""
    labels = lambda *years: adapter.scored(spark, sf, *years).agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("pos")
    ).first()
    all_years, train, test = labels(STUDY.start_year, STUDY.end_year), labels(min(STUDY.train_years), max(STUDY.train_years)), labels(STUDY.test_year)
    rows = train["pos"] + min(train["n"] - train["pos"], STUDY.negatives_per_positive * train["pos"])
    claims = Claims(
        study_records=all_years["n"], training_rows=rows, training_positives=train["pos"],
        training_pct=round(100 * train["pos"] / rows, 2), test_records=test["n"], test_positives=test["pos"],
        no_skill=round(test["pos"] / test["n"], 4),
    )
    return checks.check_sizes(study(spark, sf), train_sample(spark, sf), adapter.population(spark, sf, STUDY.test_year), claims)


@query("check_source_rows")
def check_source_rows(spark, sf):
    """The chunk count against the number of rows."""
    lines = adapter.table(spark, sf, "lineitem")
    return checks.check_source_rows(source_row_count(lines, 5_000), -(-lines.count() // 5_000))


@query("baseline_reproduction_gate")
def baseline_reproduction_gate(spark, sf):
    """The refitted baseline against the separately fitted and stored model."""
    train = stored_sample(spark, sf)
    evaluated = adapter.population(spark, sf, STUDY.validation_year, STUDY.test_year)
    model = models.train_logreg(train, STUDY)
    scores = model.score(evaluated, F.col("year").alias("period"), "target")
    stored = metrics.evaluate(scores, STUDY.decision_threshold, ["period"])
    expected = checks.long_metrics(stored.withColumn("variant", F.lit("baseline")))
    refitted = models.year_ablation(train, evaluated, STUDY, ["baseline"])
    return checks.baseline_gate(checks.long_metrics(refitted), expected)
