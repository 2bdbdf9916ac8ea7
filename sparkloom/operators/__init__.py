"""Relational operators of the retrieval engine."""
