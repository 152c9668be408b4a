"""Operators for preparing training text, and their registered queries.

Nothing else in the library imports this subpackage.
"""
