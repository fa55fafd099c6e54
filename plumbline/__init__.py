"""plumbline: a PySpark-native retrieval and text/vector analytics engine."""

__version__ = "0.1.0"
