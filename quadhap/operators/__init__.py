"""Operators over ``(sample, gene)``-keyed DataFrames."""
