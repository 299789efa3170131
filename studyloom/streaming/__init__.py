"""Structured Streaming over submission events."""
