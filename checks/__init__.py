"""Queries over the given tables, each with the same result in plain SQL."""
