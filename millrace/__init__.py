"""Spark-first operators for building, auditing and scoring text and conversation datasets."""
