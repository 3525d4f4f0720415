"""Spark-native analytics for short-lived event streams described in free text."""
