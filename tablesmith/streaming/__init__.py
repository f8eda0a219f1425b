"""Incremental copying with Structured Streaming."""
