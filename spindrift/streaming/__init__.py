"""Structured Streaming forms of operators over append-only logs."""
