"""Spark-native validated bulk load."""
