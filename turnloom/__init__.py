"""Data work for conversational recommendation, written as Spark DataFrame jobs."""

from turnloom.settings import Settings

__all__ = ["Settings"]
