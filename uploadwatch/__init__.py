"""Finds and ranks unauthorised re-uploads of licensed media with PySpark DataFrames."""
