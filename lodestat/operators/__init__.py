"""Operators: DataFrame in, DataFrame out, lazily."""
