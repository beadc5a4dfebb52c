"""quarrydf: a PySpark-native analytics engine for chunked, typed columnar tables."""

__version__ = "0.1.0"
