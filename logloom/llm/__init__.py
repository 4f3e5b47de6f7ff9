"""Operators of a training-data pipeline over ``documents``-like tables.

Nothing outside this folder imports it except ``__spark_entry__``. ``queries`` holds the registered
queries; every other module is one operator with its own general interface.
"""
