"""lumenfold: retrieval, rule classification, scoring and evaluation as lazy Spark plans."""

__version__ = "0.1.0"
