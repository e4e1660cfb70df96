"""Whole pipelines: feature build, quality filter, training matrix, error report."""
