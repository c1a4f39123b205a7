"""Palimpsest: provenance and incident analytics for agent memory, on Spark DataFrames."""
