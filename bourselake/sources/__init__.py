"""Readers: CSV files, tables inside raw web pages, and text."""
