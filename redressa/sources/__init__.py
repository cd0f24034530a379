"""Readers, writers and the complaint-shaped view over the given tables."""
