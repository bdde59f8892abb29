"""Spark-native analytics over comic and web-page tables."""
