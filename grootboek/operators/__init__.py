"""Operators: functions from DataFrames to a DataFrame."""
