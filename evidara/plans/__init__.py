"""Queries over the tables, composed of the library's operators."""
