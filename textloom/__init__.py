"""A Spark-first text annotation and analytics engine."""

from .session import ship

__all__ = ["ship"]
