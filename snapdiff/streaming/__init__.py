"""Structured Streaming twins of the diffs and of the log report."""
