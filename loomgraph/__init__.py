"""Spark-native analytics of typed, weighted graphs over path-addressed hierarchies."""
