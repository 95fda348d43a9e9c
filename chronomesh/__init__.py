"""Spatio-temporal event analytics on PySpark."""
