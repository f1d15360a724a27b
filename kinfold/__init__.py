"""Spark-native entity resolution, evidence graph and reference analytics."""
