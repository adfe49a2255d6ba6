"""Operators on sparse matrices and vectors held as DataFrames."""
