"""A PySpark-native engine for preparing, auditing and scoring large text and speech corpora."""

__version__ = "0.1.0"
