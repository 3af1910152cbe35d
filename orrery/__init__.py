"""A PySpark-native analytics engine for product, time-series, evaluation and retrieval data."""
