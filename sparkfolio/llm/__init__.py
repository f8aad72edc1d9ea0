"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it.  Each module holds one operator with a
general DataFrame -> DataFrame interface; :mod:`sparkfolio.llm.queries` wraps
them into the registered ``opN_*`` queries and their DuckDB twins.
"""
