"""Recruiting and workforce analytics as Spark DataFrame operators."""
