"""Spark-native research on rule-based daily trading strategies."""
