"""Operators for large-scale training-data preparation.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries and ``sql`` their DuckDB twins.  Nothing outside this
subpackage imports it.
"""
