"""archive_lens: a PySpark-native engine for exported chat archives."""
