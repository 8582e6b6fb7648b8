"""Change-context analytics on Spark: source corpora as relational tables."""

__version__ = "0.1.0"
