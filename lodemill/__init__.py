"""Lodemill: geometry, graph and text analytics on PySpark DataFrames."""
