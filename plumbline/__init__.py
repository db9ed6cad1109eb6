"""A PySpark-native engine for indexed source and text corpora."""

__version__ = "0.1.0"
