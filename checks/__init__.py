"""Registered queries over the sample tables and the SQL stating their results."""
