"""Grounded dialogue memory as set-based Spark jobs."""
