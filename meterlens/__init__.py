"""Interval-meter analytics and corpus preparation on PySpark DataFrames."""
