"""Operators of the document and scene flows."""
