"""Structured Streaming jobs over event streams."""
