"""Millrace: search, ranking, evaluation and corpus preparation as Spark jobs."""
