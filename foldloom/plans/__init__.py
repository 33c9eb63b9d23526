"""Composed plans: feature engineering, search, recommendation, final training."""
