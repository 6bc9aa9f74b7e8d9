"""Spark-native analytics over source trees, documents and their history."""

__version__ = "0.1.0"
