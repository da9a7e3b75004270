"""Spark-native graph, retrieval and document analytics."""
