"""Spark-native literature graph, hybrid retrieval and corpus preparation."""

__version__ = "0.1.0"
