"""Spark-native analytics for calendar intervals."""
