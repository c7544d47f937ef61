"""Spark-native preparation of large text and source-code corpora."""
