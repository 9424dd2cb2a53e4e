"""Study design: every tunable value, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# The raw export's column headers and the short names used here.
# ---------------------------------------------------------------------------
RAW_TO_SHORT = {
    "Complaint ID": "complaint_id",
    "Date received": "date_received",
    "Timely response?": "timely_response",
    "Consumer complaint narrative": "narrative",
    "Product": "product",
    "Sub-product": "sub_product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Company": "company",
    "State": "state",
    "Submitted via": "channel",
}

CATEGORICAL = ("product", "sub_product", "issue", "sub_issue", "company", "state", "channel")
NUMERIC = ("year", "month", "quarter")

# Fields only known after the response; never model inputs.
LEAKAGE_FIELDS = (
    "Company response to consumer",
    "Company public response",
    "Consumer disputed?",
    "Consumer consent provided?",
    "Date sent to company",
)

# Strings that a CSV reader with default settings treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Redaction markers that carry no meaning in a narrative.
REDACTION_TOKENS = ("xxxx", "xx", "xxxxxxxx", "xxxxxxxxxxxx")

# Names of levels in encoded columns.
MISSING_LEVEL = "MISSING"
INFREQUENT_LEVEL = "infrequent_sklearn"


@dataclass(frozen=True)
class StudyConfig:
    """Parameters of one study. Defaults are the published design. Fixed values."""

    start_year: int = 2020
    end_year: int = 2025
    train_years: tuple[int, ...] = (2020, 2021, 2022, 2023)
    validation_year: int = 2024
    test_year: int = 2025

    negatives_per_positive: int = 5
    seed: int = 42

    decision_threshold: float = 0.60
    sweep: tuple[float, ...] = (
        0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90,
    )

    categorical: tuple[str, ...] = CATEGORICAL
    numeric: tuple[str, ...] = NUMERIC
    leakage_fields: tuple[str, ...] = LEAKAGE_FIELDS
    min_level_count: int = 10

    logistic_c: float = 1.0
    logistic_iterations: int = 1000
    tree_count: int = 500
    tree_depth: int = 6
    tree_step: float = 0.1
    fit_rows_per_task: int = 50_000  # ours: the partitioning of a fit
    fit_entries_per_task: int = 500_000  # ours: the same for texts, by entries of their vectors

    text_min_df: int = 5
    text_max_terms: int = 50_000
    text_min_train_rows: int = 100
    text_min_eval_rows: int = 50

    queue_rows: int = 50_000
    top_companies: int = 40
    company_min_rows: int = 500
    read_chunk_rows: int = 500_000

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.categorical, *self.numeric)

    @property
    def last_train_year(self) -> int:
        return max(self.train_years)


@dataclass(frozen=True)
class Claims:
    """Published numbers that the verification step checks. Fixed values."""

    positives_above_threshold: int = 3_242
    flagged_rows: int = 26_154
    encoded_features: int = 971
    text_rows: int = 53_452
    text_pct: float = 41.72
    text_rate_pct: float = 21.23
    source_chunks: int = 35
    study_records: int = 11_209_689
    training_rows: int = 128_118
    training_positives: int = 21_353
    training_pct: float = 16.67
    test_records: int = 5_442_974
    test_positives: int = 24_557
    no_skill: float = 0.0045
    # (period, recall, average precision) of the reported model, reproduced within five percent.
    baseline: tuple[tuple[int, float, float], ...] = ((2024, 0.4362, 0.2403), (2025, 0.1320, 0.1156))
    baseline_tolerance: float = 0.05
