"""Millrace: a PySpark-native engine for preparing multimodal training data."""

__version__ = "0.1.0"
