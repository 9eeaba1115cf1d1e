"""Row-level operators: profiling, validation, reshapes, splits, scoring, metrics, learners, audits."""
