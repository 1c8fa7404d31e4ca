"""Retrieval, answer-quality analytics and corpus preparation as Spark jobs."""
