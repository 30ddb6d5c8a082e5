"""medialake: a Spark-native engine for media libraries."""
