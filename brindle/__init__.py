"""brindle: a Spark-first engine for code-surface analytics and text corpora."""

__version__ = "0.1.0"
