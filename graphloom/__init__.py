"""Spark-first graph, segment and spatial analytics."""

__version__ = "0.1.0"
