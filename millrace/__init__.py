"""Queries, retrieval and training-data preparation on Apache Spark."""
