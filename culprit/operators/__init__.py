"""Relational operators of the engine: DataFrames in, DataFrames out."""
