"""Operators: functions from DataFrames to DataFrames."""
