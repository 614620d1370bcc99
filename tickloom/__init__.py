"""Causal bar analytics as Spark DataFrame jobs."""
