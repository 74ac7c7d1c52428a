"""Structured Streaming forms of ingest, dedup, trends and vocabulary."""
