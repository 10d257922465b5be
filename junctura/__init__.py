"""Spark-native breakpoint analytics."""
