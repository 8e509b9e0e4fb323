"""A Spark-native analytics library for text-heavy event and document data."""
