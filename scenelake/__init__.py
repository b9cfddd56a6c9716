"""Spark-native retrieval, parsing and document analytics over screenplay collections."""
