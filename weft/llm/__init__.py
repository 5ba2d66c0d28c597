"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and keeps a general interface; ``queries`` derives the digest columns
that the registered queries return.
"""
