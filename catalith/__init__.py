"""Spark-native analytics over asset metadata: entries in, answers out, as DataFrames."""
