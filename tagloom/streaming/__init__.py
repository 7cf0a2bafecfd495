"""Structured Streaming twins of the monitor operators."""
