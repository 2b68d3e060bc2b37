"""Splits, preparation, models, calibration, metrics and tuning on Spark."""
