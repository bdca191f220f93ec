"""Queries to DataFrames."""
