"""Registered queries over the test tables, each with a DuckDB twin where SQL can say it."""
