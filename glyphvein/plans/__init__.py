"""Whole extractions: options, the job over files, statistics, and the command line."""
