"""Spark-native set-valued classification analytics."""
