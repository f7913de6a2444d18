"""Structured Streaming forms of window statistics and liveness."""
