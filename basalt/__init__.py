"""Basalt: a small SQL engine and its operators on PySpark DataFrames."""
