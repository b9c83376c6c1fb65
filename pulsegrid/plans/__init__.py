"""Queries over the tables, each with the SQL that must return the same rows."""
