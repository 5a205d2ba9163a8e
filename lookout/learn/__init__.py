"""Data preparation, classifiers and evaluation tables."""
