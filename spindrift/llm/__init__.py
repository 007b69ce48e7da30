"""Operators for preparing language-model training data, each a Spark job over DataFrames.

Nothing outside this subpackage imports it.  ``queries.py`` binds the operators to the test tables.
"""
