"""Inkloom: a Spark-native engine for mirrored documentation catalogs."""

__version__ = "0.1.0"
