"""A PySpark-native engine that turns recognised page text into clean, scored, queryable data."""
