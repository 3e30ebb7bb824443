"""Structured Streaming jobs; each has a batch twin in ``plans`` or ``operators``."""
