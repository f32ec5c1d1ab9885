"""Spark-native analytics for conversational memory tables."""
