"""plexus: a PySpark-native engine for dependency graphs of database schemas."""

__version__ = "0.1.0"
