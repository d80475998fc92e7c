"""Operators on frames, episodes and tasks; each takes and returns DataFrames."""
