"""Incremental ingestion of transaction files with Structured Streaming."""
