"""Scalar functions on number columns, as Column expressions."""
