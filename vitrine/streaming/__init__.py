"""Incremental page ingest with Structured Streaming."""
