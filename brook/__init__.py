"""Spark-native queries over streams of short timestamped records, and operators for training text."""
