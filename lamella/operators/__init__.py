"""Relational operators as functions on DataFrames."""
