"""A PySpark-native analytics engine for candidate, document and contract data."""
