"""Inputs as rows of bytes, and outputs as lines."""
