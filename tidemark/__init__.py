"""Spark-native analytics over time-bounded announcements."""
