"""A Spark-native engine for facts in narrative text."""
