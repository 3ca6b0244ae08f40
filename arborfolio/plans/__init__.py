"""Whole studies, and the catalogue of queries with their SQL."""
