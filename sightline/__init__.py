"""Spatial visibility analytics on PySpark."""
