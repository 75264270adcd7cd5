"""Spark-native time-series analytics: JSON query algebra and SQL over DataFrames."""

__version__ = "0.1.0"
