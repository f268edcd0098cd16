"""Readers, writers and page ingest."""
