"""Readers, writers and the inputs derived from the benchmark tables."""
