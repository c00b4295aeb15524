"""Sequence-preservation audit of genome graphs, as Spark plans."""

__version__ = "0.1.0"
