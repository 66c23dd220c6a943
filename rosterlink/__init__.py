"""Roster reconciliation for machine-extracted attendance rows, on Spark DataFrames."""
