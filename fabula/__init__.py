"""Spark-native text analytics for long-form prose."""
