"""Spark-native analytics for image-derived vascular feature tables."""

__version__ = "0.1.0"
