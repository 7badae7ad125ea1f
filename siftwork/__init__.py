"""Spark-native analytics for content-safety scoring."""
