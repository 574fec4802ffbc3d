"""Household-survey estimation and territorial indicators on Spark DataFrames."""
