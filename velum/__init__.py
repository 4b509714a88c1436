"""A Spark-native analytics engine for versioned, schema-bound documents."""
