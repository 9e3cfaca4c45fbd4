"""Spark-native corpus analytics: indexing, retrieval, graphs, rules and incremental upkeep."""
