"""Corpus building, search and evaluation as Spark jobs."""
