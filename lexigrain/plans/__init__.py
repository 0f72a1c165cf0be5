"""Queries over the given tables, built from the operators, each with its check in SQL."""
