"""tally: a PySpark-native analytics engine for double-entry books."""
