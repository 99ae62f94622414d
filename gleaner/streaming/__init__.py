"""Structured Streaming forms of the polled operators."""
