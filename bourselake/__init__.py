"""bourselake: daily market-data analytics as plain Spark DataFrame functions."""
