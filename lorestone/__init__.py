"""Lorestone: knowledge-base and training-data analytics as PySpark DataFrame jobs."""
