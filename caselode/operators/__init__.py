"""Operators: DataFrame in, DataFrame out; nothing is collected unless a docstring says so."""
