"""Collective data processing over sets of dense vectors, and the analytics around it, on PySpark."""
