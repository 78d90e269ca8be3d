"""Spark-native analytics for location traces."""
