"""A Spark-native analytics engine for long-read sequence tables."""

__version__ = "0.1.0"
