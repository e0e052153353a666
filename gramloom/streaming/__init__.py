"""Structured Streaming forms of the per-record operators."""
