"""A Spark-native engine for text corpora, event traces and small numeric experiments."""
