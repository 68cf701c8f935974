"""Spark-native document retrieval and training-data preparation."""

__version__ = "0.1.0"
