"""Spark-native analytics over collectible-card market data."""
