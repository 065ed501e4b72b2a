"""Readers that turn native transcript formats into the common event schema."""
