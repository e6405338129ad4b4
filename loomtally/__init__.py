"""Spark-first analytics over reported statistical results in article text."""

__version__ = "0.1.0"
