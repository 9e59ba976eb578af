"""Spark-native extraction of readable text from binary data."""
