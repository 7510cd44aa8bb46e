"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it. Each operator lives in a module of
its own; :mod:`strandlake.llm.queries` registers the queries and their SQL.
"""
