"""Streams through the batch operators; an extension of the batch engine."""
