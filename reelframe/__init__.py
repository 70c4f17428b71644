"""A PySpark engine for segment, graph, vector and text data."""
