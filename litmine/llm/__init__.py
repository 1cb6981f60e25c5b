"""Operators that large training-data pipelines need. Nothing outside this folder imports it."""
