"""Tidemark: a Spark-native engine for volatility and time-series analytics."""

__version__ = "0.1.0"
