"""feedlens: a PySpark-native engine for monitoring news and document feeds."""
