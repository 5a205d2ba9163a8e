"""Operators for building training text: filters, duplicates, mixing, scoring, formatting, extraction."""
