"""Spark-native analytics over public-form catalogs."""
