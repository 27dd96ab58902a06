"""Claim grounding over tables of notes, on Spark DataFrames."""
