"""A Spark-native engine for evidence tables and training-data preparation."""
