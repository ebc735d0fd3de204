"""Structured Streaming forms of ingest and aggregation."""
