"""Queries over the given tables, each with SQL that must return the same rows."""
