"""Scalar functions and expressions as Columns."""
