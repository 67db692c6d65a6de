"""Marketplace analytics and recommendation operators as Spark DataFrame functions."""

__version__ = "0.1.0"
