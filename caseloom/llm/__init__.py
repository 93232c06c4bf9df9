"""Operators of a large-scale training-data pipeline, each a set of DataFrame functions.

Nothing outside this subpackage imports it; ``queries.py`` lists its registered queries.
"""
