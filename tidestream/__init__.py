"""Spark-first analytics over image-arrival streams and their measurements."""
