"""Particle and object-catalogue analytics on Spark DataFrames."""

from cosmolake.session import get_spark

__all__ = ["get_spark"]
