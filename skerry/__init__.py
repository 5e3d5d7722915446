"""Spark-native analytics over vectors, small graphs and category labels."""
