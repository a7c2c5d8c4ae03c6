"""Incremental forms of operators on Structured Streaming."""
