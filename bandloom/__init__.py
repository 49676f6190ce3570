"""Spark-native hyperspectral band-selection analytics."""
