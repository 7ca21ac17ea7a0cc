"""Spark-native vector, metric and dataset operators."""
