"""Spark-native event intelligence: noisy text in, searchable and measured events out."""
