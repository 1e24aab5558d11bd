"""Spark-native analytics over array-valued scan data and the tables derived from it."""
