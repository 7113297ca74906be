"""Spark-native analytics over broadcast vehicle-message traces."""
