"""Spark-native engine for symmetric banded matrices."""

__version__ = "0.1.0"
