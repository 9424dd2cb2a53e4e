"""The steps of a study. They exchange tables through a workspace, so each can run on its own."""

from .study import (
    ablate,
    add_decile_file,
    audit_population,
    choose_threshold,
    diagnose,
    evaluate_test,
    export_dashboard,
    figure_tables,
    ingest,
    prepare_sample,
    run_study,
    train_models,
    verify_claims,
)

__all__ = [
    "ablate", "add_decile_file", "audit_population", "choose_threshold", "diagnose", "evaluate_test",
    "export_dashboard", "figure_tables", "ingest", "prepare_sample", "run_study", "train_models",
    "verify_claims",
]
