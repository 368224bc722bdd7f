"""Whole analysis jobs, from the input tables to the written reports."""
