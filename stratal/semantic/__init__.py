"""Measures over a star schema."""
