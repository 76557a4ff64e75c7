"""Spark-native near-duplicate and campaign analytics."""
