"""Continuous runs of the batch flows."""
