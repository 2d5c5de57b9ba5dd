"""Operators of a training-data pipeline: each is a function from DataFrame to DataFrame.

Nothing else in the library imports this subpackage. Queries and SQL twins are in ``queries``.
"""
