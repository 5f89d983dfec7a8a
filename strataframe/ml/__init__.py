"""Metrics, folds, models, registry, serving and explanation."""
