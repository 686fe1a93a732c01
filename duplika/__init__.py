"""Spark-native search, alignment and decomposition of long approximate repeats."""

__version__ = "0.1.0"
