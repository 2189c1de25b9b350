"""Structured Streaming jobs over arriving pages and searches."""
