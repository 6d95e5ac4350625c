"""Spark-first engine for preparing and auditing retrieval-training data."""
