"""Scans, sinks and the review-shaped views over the test tables."""
