"""A Spark-native engine for sentiment and market panels, networks and their statistics."""
