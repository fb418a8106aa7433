"""Spark-native load-signature analytics."""
