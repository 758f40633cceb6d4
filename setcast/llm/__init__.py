"""Operators for large training-text pipelines, each expressed as Spark jobs."""
