"""Operators for training data, one module per method, with their registered queries in `queries`.

Nothing else in the library imports this package.
"""
