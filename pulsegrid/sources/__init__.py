"""Readers and the tables that queries work on."""
