"""Repeat analysis of large sequence collections on Spark DataFrames."""
