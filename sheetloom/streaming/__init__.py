"""Structured Streaming forms of the rate limit and of row-wise fixes."""
