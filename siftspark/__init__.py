"""Hybrid retrieval and incremental embedding analytics on Spark."""
