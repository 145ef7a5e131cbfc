"""Spark-native document analytics: declarative DataFrame operators for text corpora."""
