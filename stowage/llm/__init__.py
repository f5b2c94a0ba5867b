"""Operators for preparing language-model training data, one module each.

Nothing else in the library imports this subpackage. `queries.py` registers
them under their production parameters.
"""
