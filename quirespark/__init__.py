"""Spark-native document analytics: blocks, layout geometry, job queues and text as DataFrames."""

__version__ = "0.1.0"
