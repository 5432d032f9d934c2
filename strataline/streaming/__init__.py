"""Incremental sync of changing sources, and windows over event streams."""
