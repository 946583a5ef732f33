"""Spark-native analytics over text records, vectors, graphs, sessions and request logs."""
