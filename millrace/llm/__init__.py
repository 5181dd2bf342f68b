"""Operators for training-data pipelines over text at corpus scale."""
