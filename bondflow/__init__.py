"""Temporal-graph reaction analytics on Spark."""
