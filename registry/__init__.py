"""Registered queries on the test tables, and their equivalents in SQL."""
