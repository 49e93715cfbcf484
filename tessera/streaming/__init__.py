"""Incremental ingest of N-Triples."""
