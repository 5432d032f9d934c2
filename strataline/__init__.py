"""Retrieval, relational and training-data operators as lazy PySpark plans."""
