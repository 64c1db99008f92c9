"""Operators: functions from DataFrames to DataFrames; none creates a session or collects rows."""
