"""Spark-native analytics for engineering standards and other structured prose."""

__version__ = "0.1.0"
