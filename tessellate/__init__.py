"""Spark-native catalog search, roll-up and document-compare engine."""
