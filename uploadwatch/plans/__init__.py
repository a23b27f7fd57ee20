"""Whole plans: the run, and queries over the generic tables."""
