"""Operators of a training-data pipeline: dedup, scoring, filtering, encoding, storage.

Every operator takes and returns DataFrames; `queries.py` registers one query
per operator. Nothing outside this subpackage imports it.
"""
