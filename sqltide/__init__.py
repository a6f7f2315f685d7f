"""Spark-native analytics over captured database traffic."""
