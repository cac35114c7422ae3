"""Structured Streaming versions of the online paths."""
