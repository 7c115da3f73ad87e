"""A Spark-native engine for building table-entity-linking datasets."""
