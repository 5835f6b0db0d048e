"""Operators: functions from DataFrames to DataFrames, with the clock passed in."""
