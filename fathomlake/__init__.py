"""A PySpark-native feature-analytics engine."""
