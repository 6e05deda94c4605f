"""Wearable-health analytics expressed as Spark DataFrame operators keyed by user and date."""
