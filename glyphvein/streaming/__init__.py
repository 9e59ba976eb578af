"""Extraction from streams of binary values."""
