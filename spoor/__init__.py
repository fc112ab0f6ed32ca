"""spoor: a PySpark-native engine for evidence retrieval over conversation traces."""

__version__ = "0.1.0"
