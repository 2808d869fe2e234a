"""Scores as grouped aggregations: one row per ``by`` group, however many models, folds or languages."""
