"""Spark-native analytics for neural recordings and animal behaviour."""

__version__ = "0.1.0"
