"""Scalar and aggregate functions with the dialect's own typing."""
