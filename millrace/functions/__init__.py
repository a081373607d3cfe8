"""Scalar functions: text, numbers, JSON."""
