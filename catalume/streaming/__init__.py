"""Structured Streaming forms of the catalogue operators."""
