"""Readers: payload directories, snapshots, JSON, text and HTML pages."""
