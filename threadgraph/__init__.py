"""Spark-native analytics over threaded reader discussions."""
