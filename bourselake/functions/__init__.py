"""Scalar rules of the data model, written as Column expressions."""
