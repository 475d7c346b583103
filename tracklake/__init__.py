"""Spark-native operators for track, identity and observation data."""
