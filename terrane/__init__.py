"""A Spark-native engine for scalar fields on weighted graphs."""
