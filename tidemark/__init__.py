"""Tidemark: market and macro time-series analytics as Spark jobs."""
