"""Operators of a training-data pipeline over ``documents``-like tables.

Nothing else in the library imports this package. Each module holds one
operator with its general interface; ``queries`` derives the registered
``opN_<name>`` results from them.
"""
