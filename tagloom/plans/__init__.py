"""Datasets derived from the given tables, and the registered queries with their SQL."""
