"""Structured Streaming over change feeds."""
