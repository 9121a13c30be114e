"""Streaming forms of the correlation operators."""
