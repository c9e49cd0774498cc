"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``registry.queries`` and
``registry.oracle_sql`` list the production query of every operator.
"""
