"""Structured Streaming forms of the ingest, cutting and deduplication operators."""
