"""Scans, derived test shapes and sinks."""
