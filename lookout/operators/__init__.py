"""Relational, window, series and decision operators (DataFrame in, DataFrame out)."""
