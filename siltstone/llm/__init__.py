"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it; deleting the folder leaves the
rest of the library whole. ``queries.py`` registers the queries.
"""
