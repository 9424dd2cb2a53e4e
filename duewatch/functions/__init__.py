from .columns import (
    as_missing,
    clip_probability,
    days_between_years,
    fill_missing_levels,
    is_late,
    parse_date,
    passes,
    row_count,
    safe_ratio,
    uniform_bin,
)
from .text import strip_accents, with_terms

__all__ = [
    "as_missing", "clip_probability", "days_between_years", "fill_missing_levels", "is_late",
    "parse_date", "passes", "row_count", "safe_ratio", "uniform_bin", "strip_accents", "with_terms",
]
