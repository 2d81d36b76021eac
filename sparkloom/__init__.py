"""Spark-native analytics over software-engineering knowledge."""

__version__ = "0.1.0"
