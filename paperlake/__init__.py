"""paperlake: a PySpark-native analytics engine for scholarly-paper archives."""
