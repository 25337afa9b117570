"""Operators: each takes DataFrames and returns a DataFrame, without running a job unless it says so."""
