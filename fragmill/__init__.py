"""fragmill: Spark-native analytics over three-part molecules and their records."""
