"""Pipelines (import, summaries, export) and the query registry."""
