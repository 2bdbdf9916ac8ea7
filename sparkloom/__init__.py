"""Spark-native retrieval, text analytics and data preparation."""
