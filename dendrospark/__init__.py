"""Spark-native single-cell trajectory analytics."""
