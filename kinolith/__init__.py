"""Spark-first analytics over entity and measurement tables."""
