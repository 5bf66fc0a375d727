"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus column names and returns a DataFrame; ``queries`` binds them to
the driver's tables.
"""
