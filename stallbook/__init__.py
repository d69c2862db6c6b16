"""Spark-native analytics for second-hand ticket listings."""
