"""PySpark-native analytics for procurement data."""
