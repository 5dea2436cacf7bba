"""Palimpsest: Spark-native recovery of content that was meant to be gone."""
