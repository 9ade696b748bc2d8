"""Spark operators for state-transition studies on large tables."""

__version__ = "0.1.0"
