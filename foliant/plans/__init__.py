"""Flows made of the operators."""
