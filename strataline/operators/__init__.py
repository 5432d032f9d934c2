"""Retrieval, relational, ingestion and lookup operators: functions from DataFrames to DataFrames."""
