"""A Spark-native engine for long-document evaluation data."""
