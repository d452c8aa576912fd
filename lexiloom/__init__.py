"""Spark-native operators for preparing, checking and sharding text corpora."""

__version__ = "0.1.0"
