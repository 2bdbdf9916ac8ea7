"""Composed plans: index build, routing, search, evaluation."""
