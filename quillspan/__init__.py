"""Spark-native engine for entity panels, data quality and training-data preparation."""
