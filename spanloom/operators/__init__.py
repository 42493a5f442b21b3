"""Interval, recurrence and scheduling operators on DataFrames."""
