"""missive: a Spark-native analytics engine for message and document streams."""
