"""Operators of the engine: functions from keyed DataFrames to DataFrames."""
