"""Operators for building training corpora, each on whole Spark tables."""
