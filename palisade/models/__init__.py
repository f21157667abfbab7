"""Anomaly models trained and applied on Spark."""
