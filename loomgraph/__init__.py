"""Spark-native analytics over software knowledge graphs and text corpora."""
