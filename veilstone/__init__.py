"""Sensitive-text analytics on PySpark."""
