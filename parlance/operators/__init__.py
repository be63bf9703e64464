"""Operators: functions from DataFrames to DataFrames, declared lazily."""
