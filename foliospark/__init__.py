"""Spark-native analytics for long, structured documents."""

__version__ = "0.1.0"
