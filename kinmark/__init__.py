"""A PySpark engine for bibliographic record linkage."""

__version__ = "0.1.0"
