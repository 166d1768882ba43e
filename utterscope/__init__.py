"""Spark-native analytics for recorded utterance events."""
