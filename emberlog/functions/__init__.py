"""Scalar helpers and configuration."""
