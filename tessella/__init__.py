"""Spark-native record-linkage blocking engine."""

__version__ = "0.1.0"
