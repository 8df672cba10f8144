"""Spark-native, token-budgeted document selection."""
