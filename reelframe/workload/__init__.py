"""Queries over the test tables, one or more per operator, each with DuckDB SQL where SQL can express it."""
