"""Keyed state over streams, and the same rules over finished tables."""
