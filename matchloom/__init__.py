"""matchloom: a PySpark-native analytics engine for match, event and text data."""
