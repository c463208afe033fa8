"""Cohort, event and evaluation operators on Spark DataFrames."""
