"""Operators for training-data pipelines on text and vectors."""
