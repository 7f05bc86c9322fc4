"""Telemetry snapshots on Spark: ingest, normalise, compare, report and follow."""
