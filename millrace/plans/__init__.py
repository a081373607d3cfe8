"""Whole pipelines, and the queries that the driver runs."""
