"""Operators on long panels; each takes and returns DataFrames."""
