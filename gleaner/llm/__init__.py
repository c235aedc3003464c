"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; the thin queries that bind them to the
synthetic tables are in ``queries.py``.
"""
