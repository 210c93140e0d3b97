"""A Spark-native engine for digital-ink documents and note libraries."""
