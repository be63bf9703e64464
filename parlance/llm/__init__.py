"""Operators for preparing training text and vectors.

One module per operator (``opN_*`` in ``queries.py`` applies each to its
whole table); nothing outside this subpackage imports it.
"""
