"""Readers, file plans and published tables."""
