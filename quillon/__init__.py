"""Spark-native retrieval, recommendation and evaluation engine for item corpora."""
