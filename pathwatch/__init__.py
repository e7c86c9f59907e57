"""A Spark-native engine for security event analytics."""
