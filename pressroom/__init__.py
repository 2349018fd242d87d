"""Spark-native news-recommendation analytics."""
