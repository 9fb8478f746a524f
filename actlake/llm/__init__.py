"""Operators for building training data out of web-scale text.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` jobs over the given tables.
"""
