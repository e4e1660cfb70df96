"""Spatial folds, estimators, nested cross-validation, scores, ensembles."""
