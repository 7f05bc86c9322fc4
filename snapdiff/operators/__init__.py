"""Joins, aggregates and diffs, DataFrame to DataFrame."""
