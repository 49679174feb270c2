"""Operators of a training-data pipeline over a `documents` DataFrame.

Nothing outside this subpackage imports it.
"""
