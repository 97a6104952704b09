"""Columns: spectral indices, lookups and classifications."""
