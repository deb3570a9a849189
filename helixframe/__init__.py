"""Spark-native analytics for sparse count matrices, gene sets, graphs and ontologies."""
