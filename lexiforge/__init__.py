"""Spark-native retrieval analytics: multilingual document pipelines as DataFrame plans."""
