"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. The modules named after
an operator hold its general interface; ``queries`` holds the thin queries.
"""
