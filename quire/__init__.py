"""Corpus analytics and hybrid passage retrieval on Spark."""
