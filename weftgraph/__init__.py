"""PySpark-native analytics over schema-governed property graphs."""
