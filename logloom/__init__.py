"""Logs and metrics analytics expressed as Spark DataFrame jobs."""
