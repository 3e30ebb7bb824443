"""Whole questions composed of operators."""
