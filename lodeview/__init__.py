"""A Spark-native engine for indexing and recalling personal files."""
