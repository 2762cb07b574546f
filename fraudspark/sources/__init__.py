"""Scans, sinks and incremental loading."""
