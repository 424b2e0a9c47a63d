"""grainmill: a Spark-native analytics engine of composable DataFrame operators."""
