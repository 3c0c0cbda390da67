"""Numeric column analytics and lossless column compression on PySpark."""
