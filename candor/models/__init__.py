"""Spark ML models over text and graph features, and their blend."""
