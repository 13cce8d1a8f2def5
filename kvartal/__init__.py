"""kvartal: a PySpark-native engine for individual-level city mobility data."""

__version__ = "0.1.0"
