"""Leak auditing and training-data preparation on PySpark."""
