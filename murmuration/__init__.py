"""murmuration: a PySpark-native engine for finding and scoring recurring units in sequence data."""
