"""Spark-native analytics for annotated records and training corpora."""
