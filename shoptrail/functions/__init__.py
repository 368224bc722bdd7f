"""Scalar and aggregate functions as column expressions."""
