"""Operators for building a training corpus. Nothing else in the library imports this package."""

from schedlens.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
