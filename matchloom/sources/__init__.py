"""Scans, schemas, drift and sinks."""
