"""Spark-native analytics for corpora of standards documents."""
