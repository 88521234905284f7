"""Constraint analytics over document collections, built on Spark DataFrames."""

from .session import get_session

__all__ = ["get_session"]
