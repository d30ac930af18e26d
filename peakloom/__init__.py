"""Spark-native analytics for sparse features of spectrum encoders."""
