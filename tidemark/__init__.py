"""Tidemark: market-tape analytics and corpus preparation as Spark jobs."""
