"""Revision analytics on Spark: identity, folding, history, diffs and planning over text observations."""

__version__ = "0.1.0"
