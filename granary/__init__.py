"""Granary: corpus preparation, mixing, audit and evaluation on PySpark."""
