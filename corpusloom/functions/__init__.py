"""Scalar functions: column expressions, and pandas UDFs where expressions can't say it."""
