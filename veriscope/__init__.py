"""A Spark-native engine for retrieval evaluation and corpus preparation."""
