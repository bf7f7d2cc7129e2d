"""Entry points that combine operators."""
