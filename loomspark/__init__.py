"""Retrieval, text and training-data analytics as Spark jobs."""
