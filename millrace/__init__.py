"""millrace: a PySpark-native engine that prepares and audits language-model training data."""

__version__ = "0.1.0"
