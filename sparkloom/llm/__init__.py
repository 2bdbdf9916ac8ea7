"""Operators for preparing training data for language models."""
