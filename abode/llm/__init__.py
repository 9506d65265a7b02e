"""Operators of a training-data pipeline over text tables (``documents``, ``conversations``).

Nothing else in the library imports this subpackage; ``registry`` holds its queries.
"""
