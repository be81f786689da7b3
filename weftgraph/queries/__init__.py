"""Queries on the driver tables, by operator family."""
