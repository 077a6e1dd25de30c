"""Structured Streaming jobs over ticks and disclosures."""
