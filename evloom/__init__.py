"""Spark-native analytics over evidence tables: identity, ranking, coverage, audit and text operators."""
