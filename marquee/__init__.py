"""Marquee: a PySpark engine for integrating, reconciling and searching event listings."""

__version__ = "0.1.0"
