"""Structured Streaming entry points (incremental ingest of raw price files)."""
