"""Spark-native operators for concentration, dependency and persistence in award-style records."""
