"""Composed analyses: several operators in one plan."""
