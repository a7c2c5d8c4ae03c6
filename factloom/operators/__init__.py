"""Operators: functions from DataFrames of facts to DataFrames."""
