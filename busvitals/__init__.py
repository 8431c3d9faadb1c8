"""Behavioral bus analytics as Spark DataFrame and Structured Streaming transformations."""
