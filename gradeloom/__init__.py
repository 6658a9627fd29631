"""Spark operators for scoring, comparing and tracking model responses."""

__version__ = "0.1.0"
