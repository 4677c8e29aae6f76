"""Spark-native features, scoring, alerts and run monitoring for transaction tables."""
