"""logloom: a PySpark-native analytics engine for ordered session logs and training-data tables."""

__version__ = "0.1.0"
