"""Timed-text analytics on Spark: segments, chunks, observations, topics and documents as DataFrames keyed by ``source_id``."""
