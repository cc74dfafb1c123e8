"""Spark-first analytics over large sparse matrices kept as relational tables."""

__version__ = "0.1.0"
