"""Operators on ordered number columns."""
