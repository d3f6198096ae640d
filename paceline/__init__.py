"""paceline: a Spark-native analytics engine for competition results."""
