"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; see ``tallyard.llm.queries`` for
the registered queries and their SQL.
"""
