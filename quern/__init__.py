"""Spark-native text-corpus curation and parallel-data engine."""
