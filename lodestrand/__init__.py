"""Spark-native interval and evaluation analytics."""
