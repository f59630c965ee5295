"""lotwise: a PySpark-native analytics engine for listing-style marketplace data."""
