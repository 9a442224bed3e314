"""Spark-native fact checking, text scanning and service metrics."""
