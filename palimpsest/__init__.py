"""Spark-native engine for locating, masking, auditing and restoring sensitive data."""
