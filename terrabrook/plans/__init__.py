"""Compositions: analyses and the catalogue of queries."""
