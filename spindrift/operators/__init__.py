"""Operators: each takes a DataFrame and returns one, lazily, with its grain in the key columns."""
