"""Skein: a PySpark-native engine for typed property graphs, ranked retrieval and corpus preparation."""
