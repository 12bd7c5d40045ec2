"""Siltstone: a Spark-native engine that builds, audits and queries retrieval corpora."""

__version__ = "0.1.0"
