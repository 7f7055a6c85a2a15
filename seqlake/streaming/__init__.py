"""Streaming ingest of mutation logs."""
