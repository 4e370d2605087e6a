"""Queries over the given tables, one module for each group of operators."""
