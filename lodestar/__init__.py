"""A PySpark-native engine for hybrid retrieval over collections of text."""
