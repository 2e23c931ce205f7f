"""Queries over the tables, with the SQL that states the same result."""
