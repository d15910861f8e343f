"""Spark-native text mining, feature selection and corpus preparation."""

__version__ = "0.1.0"
