"""Spark-native scoring of spoken responses, agreement analytics and text metrics."""
