"""Operators and queries for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes a DataFrame
and column names and returns a DataFrame; ``queries.py`` applies each one to
its whole table and derives the columns its contract asks for.
"""
