"""Structured Streaming over growing tables."""
