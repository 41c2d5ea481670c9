"""Data dictionaries for Spark: declared schemas, keys and relationships, checked against tables, emitted as DDL and turned into synthetic data."""
